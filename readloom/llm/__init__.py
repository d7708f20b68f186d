"""Operators for collections used as training data. Nothing else in the library imports this subpackage."""
