import random
from statistics import mean, median, stdev

from assaygrid.operators import metabolomics as mb


def peaks():
    rng, rows = random.Random(8), []
    samples = [(f"q{k}", "QC") for k in range(5)] + [(f"b{k}", "Blank") for k in range(3)] + [(f"s{k}", f"g{k % 2}") for k in range(10)]
    for study in "xy":
        for m in range(7):
            for a in range(3):
                level, gaps, scale = rng.uniform(50, 500), rng.choice([0, 0.1, 0.5]), rng.choice([0.1, 0.1, 3])
                for sample, kind in samples:
                    v = round(level * rng.uniform(0.8, 1.2) * (scale if kind == "Blank" else 1), 3)
                    area = None if rng.random() < gaps else 0.0 if rng.random() < 0.1 else v
                    rows.append((study, sample, f"m{m} [a{a}]", f"m{m}", area, kind))
        for sample, kind in samples:  # two molecules that agree in most samples
            v = round(rng.uniform(100, 200), 3) * (0.01 if kind == "Blank" else 1)
            rows += [(study, sample, "n1 [a]", "n1", v, kind), (study, sample, "n2 [a]", "n2", v if sample != "s3" else v + 1, kind), (study, sample, "e [a]", "e", None, kind)]
    return rows


def plain(rows):
    out = []
    for study in sorted({r[0] for r in rows}):
        table = {(s, f): a for st, s, f, _, a, _ in rows if st == study}
        kind, mol = {r[1]: r[5] for r in rows}, {r[2]: r[3] for r in rows}
        samples, features = sorted({s for s, _ in table}), sorted({f for _, f in table})
        of = lambda f, keep: [table[s, f] for s in samples if keep(kind[s])]
        bio, gone = lambda k: k not in ("QC", "Blank"), lambda a: not a
        features = [f for f in features if any(a is not None for a in of(f, lambda k: True))]
        features = [f for f in features if mean(map(gone, of(f, lambda k: k == "QC"))) <= 0.4]
        features = [f for f in features if mean(a or 0 for a in of(f, bio)) >= mean(a or 0 for a in of(f, lambda k: k == "Blank"))]
        samples = [s for s in samples if kind[s] != "Blank"]
        features = [f for f in features if mean(map(gone, of(f, lambda k: True))) <= 1 / 3]
        for f in features:
            least = min((a for a in of(f, lambda k: True) if a), default=None)
            for s in samples:
                if table[s, f] == 0:
                    table[s, f] = None if least is None else least / 2
        best = {}
        for f in features:
            qc = [a for a in of(f, lambda k: k == "QC")]
            known = [a for a in qc if a is not None]
            if len(known) >= 0.5 * len(qc) and len(known) > 1:
                best[mol[f]] = min(best.get(mol[f], (float("inf"), "")), (stdev(known) / mean(known) * 100, f))
        features = sorted(f for _, f in best.values())
        seeds, group = [], {}
        for f in features:
            alike = lambda g: sum(table[s, f] is not None and table[s, f] == table[s, g] for s in samples) / len(samples) >= 2 / 3
            group[f] = next((g for g in seeds if alike(g)), f)
            seeds += [f] if group[f] == f else []
        merged = {}
        for g in seeds:
            members = [f for f in features if group[f] == g]
            for s in samples:
                known = [table[s, f] for f in members if table[s, f] is not None]
                merged[s, "/".join(members)] = mean(known) if known else None
        features = sorted({f for _, f in merged})
        samples = [s for s in samples if mean(merged[s, f] is None for f in features) <= 0.5]
        totals = {s: sum(merged[s, f] or 0 for f in features) for s in samples if kind[s] == "QC"}
        mid = median(totals.values())
        mad = median(abs(t - mid) for t in totals.values())
        good = [s for s, t in totals.items() if mad == 0 or abs(t - mid) / mad < 3]
        ref = {}
        for f in features:
            known = [merged[s, f] for s in good if merged[s, f] is not None]
            if 1 - len(known) / len(good) <= 0.5:
                ref[f] = median(known)
        for s in samples:
            if bio(kind[s]):
                q = [merged[s, f] / ref[f] for f in ref if merged[s, f] is not None and ref[f]]
                factor = median(q) if q and median(q) else 1.0
                out += [(study, s, f, None if merged[s, f] is None else round(merged[s, f] / factor, 6)) for f in ref]
    return sorted(out, key=str)


def test_whole_chain_against_plain_python(spark):
    rows = peaks()
    got = mb.preprocess(spark.createDataFrame(rows, "study string, sample string, feature string, molecule string, area double, kind string"))
    found = sorted(((r.study, r.sample, r.feature, None if r.area is None else round(r.area, 6)) for r in got.collect()), key=str)
    want = plain(rows)
    assert any("/" in r[2] for r in want) and found == want
