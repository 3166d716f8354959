"""Queries of releases (SNK05, CMP32, CMP39, CMP43)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest
from quillspark.operators import credit as C
from quillspark.plans.credit import _rollouts
from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.sources import releases as R

ROW = ["doc_id", "lang", "source", "text"]


def _pool(table: Table) -> tuple[DataFrame, dict]:
    """Documents as a pool of six artefacts: accepted and rejected ones, three splits, and the groups of all."""
    accepted = F.col("text").rlike(r"\S") & (F.col("n_chars") >= 200)
    band = F.conv(F.substring(digest("r1", F.col("doc_id")), 1, 8), 16, 10).cast("long") % 10
    split = F.when(band == 0, "test").when(band == 1, "dev").otherwise("train")
    reason = F.when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "empty").when(F.col("n_chars") < 200, "short")
    df = table("documents").withColumns({"accepted": F.coalesce(accepted, F.lit(False)), "split": split, "reason": reason})
    parts = {"accepted": (F.col("accepted"), [*ROW, "split"]), "rejected": (~F.col("accepted"), ["doc_id", "reason"]), "groups": (F.lit(True), ["doc_id", "source", "lang"])}
    return df, parts | {s: (F.col("accepted") & (F.col("split") == s), ROW) for s in ("train", "dev", "test")}


_POOL = """p AS (SELECT doc_id, regexp_matches(text, '\\S') AND n_chars >= 200 AS accepted, ('0x' || left(sha256('r1:' || doc_id), 8))::BIGINT % 10 AS band FROM documents)"""


@query(
    f"""WITH {_POOL}, c AS (SELECT unnest(['groups', CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END, CASE WHEN accepted THEN CASE band WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END END]) AS part FROM p)
        SELECT part, count(*) AS rows, 0 AS violations FROM c WHERE part IS NOT NULL GROUP BY part"""
)
def snk05_cmp43_pool_release(table: Table) -> DataFrame:
    """Six artefacts of one pass, and how many violations a verification against the manifest finds in each."""
    df, parts = _pool(table)
    path = fresh_folder(df, "release")
    manifest = R.write_release(df, parts, path, {"version": "1"})
    counts = manifest.where("kind = 'part' and rows > 0").select("part", "rows")
    bad = R.verify_release(df.sparkSession, path, facts={"version": "1"}).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(bad, "part", "left").select("part", "rows", F.coalesce("n", F.lit(0)).cast("int").alias("violations"))


@query(
    f"""WITH {_POOL}, n AS (SELECT count(*) FILTER (accepted AND band = 1) AS dev, count(*) FILTER (accepted AND band = 0) AS test FROM p)
        SELECT part, name, rule, told, found FROM (VALUES ('dev', NULL, 'missing file', NULL, NULL), ('dev', NULL, 'unlisted file', NULL, NULL), (NULL, 'version', 'wrong fact', '2', '1')) v(part, name, rule, told, found)
        UNION ALL SELECT 'dev', NULL, 'wrong count', dev::VARCHAR, '1' FROM n UNION ALL SELECT 'test', NULL, 'wrong count', (test + 1)::VARCHAR, test::VARCHAR FROM n"""
)
def cmp39_cmp43_release_violations(table: Table) -> DataFrame:
    """A release whose dev artefact was written anew, held against another version and one more test row."""
    df, parts = _pool(table)
    path = fresh_folder(df, "broken")
    manifest = R.write_release(df, parts, path, {"version": "1"})
    df.sparkSession.range(1).selectExpr("'{}' as value").coalesce(1).write.mode("overwrite").text(f"{path}/parts/part=dev")
    test = manifest.where("kind = 'part' and name = 'test'").first()["rows"]
    found = R.verify_release(df.sparkSession, path, {"test": test + 1}, {"version": "2"})
    plain = F.col("rule").isin("missing file", "unlisted file")
    return found.select("part", F.when(~plain, F.col("name")).alias("name"), "rule", F.when(~plain, F.col("told")).alias("told"), F.when(~plain, F.col("found")).alias("found")).distinct()


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, conv_id // 4 AS grp, (conv_id % 7 + 1.0) * n / 10 AS reward FROM c),
       g AS (SELECT grp, count(*) > 1 AND stddev_pop(reward) > 1e-12 AS separates FROM r GROUP BY grp)
       SELECT part, count(*) AS rows FROM (SELECT 'rollouts' AS part FROM r UNION ALL SELECT CASE WHEN separates THEN 'useful' ELSE 'flat' END FROM r JOIN g USING (grp)) GROUP BY part"""
)
def cmp32_replay_release(table: Table) -> DataFrame:
    """Rollouts and their advantages written as a replay: all, those of groups whose rewards differ, and the rest; read back and counted."""
    rollouts = _rollouts(table).select("group", "rollout", "terminal_reward", "actions")
    scored = C.group_advantages(rollouts, ["group"], "terminal_reward", "advantage")
    useful = C.group_scores(rollouts).select("group", "separates")
    rows = C.skew_join(scored, useful, ["group"], "inner")
    path = fresh_folder(rows, "replay")
    columns = ["group", "rollout", "terminal_reward", "advantage"]
    R.write_release(rows, {"rollouts": (F.lit(True), [*columns, "actions"]), "useful": (F.col("separates"), columns), "flat": (~F.col("separates"), columns)}, path)
    held = [r["name"] for r in R.read_manifest(rows.sparkSession, path).where("kind = 'part' and rows > 0").collect()]  # three at most
    read = [R.read_part(rows.sparkSession, path, p, "rollout long").select(F.lit(p).alias("part"), "rollout") for p in held]
    return reduce(DataFrame.unionByName, read).groupBy("part").agg(F.count("rollout").alias("rows"))
