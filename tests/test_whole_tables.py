"""Tables of all samples, against brute force."""

import random
from collections import Counter

from readloom.queries.reads import queries

from .conftest import rows
from .test_operators import _store, _store_reads


def test_all_samples(spark, tmp_path):
    r = random.Random(1)
    names = [f"S{i:06d}" for i in range(15)]
    seqs = ["".join(r.choice("ACGT") for _ in range(30)) for _ in range(6)]
    data = [(r.choice(names[:14]), r.choice(seqs)) for _ in range(150)]
    _store_reads(spark, tmp_path, data)
    _store(spark, tmp_path, "samples", [(n,) for n in names], "sample string")
    n = Counter(data)
    wide = queries()["seq_table_pivot"](spark, str(tmp_path))
    assert wide.columns == ["seq", *names]
    assert rows(wide) == sorted((q, *[n[s, q] for s in names]) for q in {q for _, q in data})
    twice = sorted((s, q, 2 * k) for (s, q), k in n.items())
    new = sorted(("B" + s, q, k) for (s, q), k in n.items())
    assert rows(queries()["seq_table_merge"](spark, str(tmp_path)).select("sample", "seq", "abundance")) == sorted(twice + new)
    # of a sequence and its reverse complement, equally abundant, the first in order stays
    first = lambda q: min(q, q[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert rows(queries()["seq_table_merge_rc"](spark, str(tmp_path)).select("sample", "seq", "abundance")) == sorted((s, first(q), k) for s, q, k in twice)
