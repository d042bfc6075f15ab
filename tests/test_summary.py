"""The whole quality pipeline in plain Python: actions, merges of near duplicates among what stays, tags of what remains."""

import re

from pyspark.sql import functions as F

from lorebank.functions import text as T
from lorebank.plans import curation
from lorebank.plans.registry import QUERIES

from .test_by_hand import DIR


def test_the_summary_counts_what_remains_after_the_merges(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    some = docs.limit(12).withColumns({"doc_id": F.col("doc_id") + 100_000, "source": F.lit("site3")})  # copies of other scores
    odd = spark.createDataFrame([(200_000, "- the first President of Bangladesh was born in 1920 in the capital city", "en", "site20", 1), (200_001, "the first president of Bangladesh was born in 1920 in the capital city", "en", "site20", 1), (200_002, None, "en", "site20", 0)], docs.schema)
    docs.unionByName(some).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = curation.acted(spark, str(tmp_path)).collect()
    stay = {}
    for r in rows:
        if r.action in ("ACCEPT", "SALVAGEABLE_ACCEPT", "REFINED_ACCEPT"):
            stay[r.fact_id] = (r.refined, r.again) if r.action == "REFINED_ACCEPT" else (r.text, r.composite)
    sets, gone = {i: frozenset(re.findall(r"[^\W]+", t.lower())) for i, (t, _) in stay.items()}, set()
    ids = sorted(stay)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if i in gone:
                break
            if j not in gone and a and 20 * min(len(a), len(b)) >= 17 * max(len(a), len(b)) and 20 * len(a & b) >= 17 * len(a | b):
                gone.add(i if stay[j][1] > stay[i][1] else j)
    remain = spark.createDataFrame([(t,) for i, (t, _) in stay.items() if i not in gone], "t string").select(T.mcq_tags(F.col("t"))).collect()
    got = QUERIES["quality_pipeline_summary"](spark, str(tmp_path)).first().asDict()
    want = {"total": len(rows), **{x.lower(): sum(x in r.action for r in rows) for x in curation.ACTIONS}, "duplicates_merged": len(gone), "facts_remaining": len(remain)}
    assert len(gone) > 12 and got == want | {t: sum(t in r[0] for r in remain) for t in curation.TAG_NAMES}
