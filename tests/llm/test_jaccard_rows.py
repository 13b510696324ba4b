"""What the set join sends: bucket hashes packed, and each set once to each of its places."""

import numpy as np

from millrace.llm import common, jaccard


def test_packed_rows():
    r = np.random.default_rng(2)
    sig, node, scheme = r.integers(0, 1 << 63, 50).astype(np.uint64), r.integers(0, 1 << 48, 50), r.integers(0, 3000, 50).astype(np.uint16)
    packed = [jaccard.pack_rows(sig[a:z], node[a:z], scheme[a:z]) for a, z in ((0, 20), (20, 20), (20, 50))]
    got = jaccard.unpack_rows(packed)
    assert sum(map(len, packed)) == 14 * 50
    assert (got[0] == sig & np.uint64((1 << 48) - 1)).all() and (got[1] == node).all() and (got[2] == scheme).all()


def test_sets_move_once(spark, monkeypatch):
    """One join stands between sets and their groups: that with the places, which are joined to each other first."""
    words = [f"w{i}" for i in range(400)]
    rows = [(g * 3 + c, " ".join(words[g : g + 60]) + f" end{c}") for g in range(0, 300, 60) for c in range(3)]
    seen = []
    cut = common.cut
    monkeypatch.setattr(common, "cut", lambda df, name="cut": (seen.append(df) if name == "links" else None, cut(df, name))[1])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, i - i % 3) for i, _ in rows)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
