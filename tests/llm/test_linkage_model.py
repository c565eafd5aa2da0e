import pandas as pd
from pyspark.sql import functions as F

from orgweave.llm import linkage
from orgweave.llm.orgnames import core_likelihood
from orgweave.shared import read

D = "/root/testdata/sf0.01"


def _tables(spark):
    return [read(spark, D, t) for t in ("publication_institutions_master", "compustat_firms_standardized", "publication_firm_matches_stage1")]


def _level(a: set, b: set) -> int:
    best = 0
    for ka, ca in a:
        for kb, cb in b:
            like = max(core_likelihood(ca, cb), core_likelihood(cb, ca))
            best = max(best, (4 if ca == cb else 3 if like >= 0.05 else 2 if like > 0 else 0) if ka == kb else int(ca == cb))
    return best


def test_passes_miss_no_link_that_scoring_all_pairs_finds(spark):
    inst, firms, earlier = _tables(spark)
    parts = linkage.read_parts(inst, firms)
    pairs = linkage.candidate_pairs(parts, earlier).cache()
    model, _ = linkage.fit(pairs, parts, earlier)
    candidates = {(r["institution_id"], r["gvkey"]): r for r in pairs.collect()}
    f, i = ({r[0]: r for r in df.collect()} for df in parts[:2])
    forms = [{}, {}]
    for n, df in enumerate(parts[2:]):
        for r in df.collect():
            forms[n].setdefault(r[0], set()).add((r["kind"], r["core"]))
    known = {}
    for r in earlier.filter("institution_id is not null and gvkey is not null").collect():
        known.setdefault(r["institution_id"], set()).add(r["gvkey"].strip().rjust(6, "0"))
    agree = lambda a, b: 1 if not a or not b else 2 if set(a) & set(b) else 0
    rows, keys = [], []
    for a, x in i.items():
        for b, y in f.items():
            if (a, b) in candidates:  # relatives are found by name and host only, so a pair of theirs is a candidate
                continue
            name, tic = _level(forms[1].get(a, set()), forms[0].get(b, set())), agree(x["acronyms"], y["tics"])
            rows.append([name, agree(x["i_hosts"], y["f_hosts"]), agree(x["i_countries"], y["f_countries"]),
                agree(x["i_cities"], y["f_cities"]), 1 if name == 1 and tic == 2 else tic, 1 if not x["parents"] else 0, 0,
                1 if a not in known else 2 * (b.rjust(6, "0") in known[a]), 1 - (x["academic"] or 0)])
            keys.append((a, b))
    post = model.posterior(pd.DataFrame(rows, columns=list(linkage.LEVELS)))
    assert [k for k, p in zip(keys, post) if p >= linkage.THRESHOLD] == []


def test_the_posterior_decides(spark):
    """Candidates that only share a word, a host or a ticker are there, and only the posterior keeps them out."""
    scored = linkage.link(*_tables(spark)).cache()
    linked = {tuple(r) for r in linkage.best_links(scored).select("institution_id", "gvkey").collect()}
    blind = {tuple(r) for r in linkage.best_links(scored.withColumn("match_confidence", F.lit(1.0))).select("institution_id", "gvkey").collect()}
    extra = {r["institution_id"]: r for r in scored.collect() if (r["institution_id"], r["gvkey"]) in blind - linked}
    assert len(extra) >= 5
    assert all(r["name"] < 2 and r["match_confidence"] < linkage.THRESHOLD for r in extra.values())
