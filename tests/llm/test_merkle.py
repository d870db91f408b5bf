import hashlib
import random
import zlib

import __spark_entry__
import pytest

from assaygrid.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, the siblings before and after of each leaf by level)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, j in enumerate(at):
            run = j // 8 * 8
            paths[k].append(("".join(nodes[run:j]), "".join(nodes[j + 1 : run + 8])))
        nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [j // 8 for j in at]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified), sorted; rows are (doc_id, text, lang, source, n_chars)."""
    leaf = lambda d, t, l, s, n: h(*map(entry, (d, s, l, n, t)))
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for d, t, l, s, n in rows:
        own = leaf(d, t, l, s, n)
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        trees.setdefault((l is not None, (l or "").encode()), []).append((d is not None, d or 0, own, leaf(d, low(t), l, s, n) if tampered else own))
    trees = {k: sorted(v) for k, v in sorted(trees.items())}
    subs = {k: climb([x[2] for x in v]) for k, v in trees.items()}
    root, tops = climb([s for s, _ in subs.values()])
    out = []
    for (key, leaves), top in zip(trees.items(), tops):
        sub, paths = subs[key]
        for (known, d, own, node), p in zip(leaves, paths):
            for a, z in p + top:
                node = h(a, node, z)
            out.append((d if known else None, own, sub, root, h(*(a + z for a, z in p + top)), node, node == root))
    return sorted(out, key=str)


def corpus(n, langs):
    rng = random.Random(n)
    rows = [(k * 7 % n, rng.choice(["Some Text", "plain text", "ÄÖ Ü", "", None, "x" * 3000]) , rng.choice(langs), rng.choice(["a", None, ""]), rng.choice([k, None])) for k in range(n)]
    return rows + [(None, "no id", langs[0], "s", 1), (None, "No id", langs[0], "s", 1), (3, "twice", langs[0], "s", 1), (3, "twice", langs[0], "s", 1)]


@pytest.mark.parametrize("width,n,langs", [(3, 300, ["en", None, "", "dé"]), (1, 150, ["en", "de", None]), (1, 70, [f"l{k}" for k in range(20)]), (3, 5, ["one"]), (3, 1200, ["en", "en", "en", "de"])])
def test_against_brute_force(spark, tmp_path, monkeypatch, width, n, langs):
    monkeypatch.setattr(merkle, "LEVELS", width)
    monkeypatch.setattr(merkle, "WIDTH", 8**width)
    rows = corpus(n, langs)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == brute(rows)


def test_places_are_the_log_order():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 71, 72, 512, 519, 577):
        leaves = [h(str(k)) for k in range(n)]
        levels = merkle.levels_of(n)
        log = merkle.append(leaves, levels)
        nodes = leaves
        for k in range(levels + 1):
            assert [log[merkle.place(k, j, n, levels)] for j in range(len(nodes))] == nodes
            nodes = [h(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)]
        assert len(log) == sum(-(-n // 8**k) for k in range(levels + 1))
