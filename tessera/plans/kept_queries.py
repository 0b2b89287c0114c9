"""What is kept up to date over changes, over documents and events: each equals a rebuild of the state after the last change."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clones, generic
from tessera.operators.clone_index import CloneIndex
from tessera.operators.hot_keys import heavy_keys
from tessera.operators.kept_rollups import KeptRollups
from tessera.operators.rollups import score_measured
from tessera.plans.analysis_queries import LIMITS, MARKERS, SCORES_SQL, scored_sums
from tessera.plans.clone_queries import FNV_SQL, PRINTS_SQL
from tessera.plans.corpus import FILES_SQL, TOKENS_SQL, document_files, table
from tessera.session import shared_folder
from tessera.sources import cache
from tessera.streaming.quiet import event_edits, quiet_rows, quiet_stream

#: Quiet time after which an event counts as its user's last, and how late events may come.
QUIET_MS, LATE = 6 * 3_600_000, "1 hour"
#: Tokens that occur so often are heavy.
HEAVY = 2000


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents as they are first, those that an edit doubles, and folders that are deleted."""
    files = document_files(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    edited = files.where("path LIKE 'src1%'").withColumn("text", F.concat(text, F.lit("\n"), text))
    gone = files.where("path LIKE 'src2%/fr/%'").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    return files, edited, gone


#: Documents as they are after these changes.
EDITED_SQL = "edited AS (SELECT doc_id, source, lang, CASE WHEN coalesce(source, 'none') LIKE 'src1%' THEN coalesce(text, '') || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents WHERE NOT (coalesce(source, 'none') LIKE 'src2%' AND coalesce(lang, 'none') = 'fr'))"


def after_changes(sql: str) -> str:
    """A query over documents as one over the edited ones."""
    return f"{EDITED_SQL}, {sql.replace(FILES_SQL, FILES_SQL.replace('FROM documents', 'FROM edited'))}"


def debounced_events(spark, sf_dir):
    """Each user's events that nothing of theirs follows within six hours."""
    return quiet_rows(event_edits(table(spark, sf_dir, "events")), "path", "ts", QUIET_MS, "generation").select("path", "generation", "text")


def debounced_event_stream(spark, sf_dir):
    """The same from a stream of eight slices: what is decided when the watermark has come to the last one's end."""
    folder = shared_folder(spark, "events")
    edits = event_edits(table(spark, sf_dir, "events"))
    edits.repartitionByRange(8, "ts").write.parquet(f"{folder}/in")
    end = spark.createDataFrame([("clock", datetime.datetime(2100, 1, 1), 0, None)], edits.schema)  # all others are decided when it has come
    end.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    quiet = quiet_stream(stream, "path", "ts", QUIET_MS, "60 days", ("generation",))  # slices may come in any order
    quiet.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(edits.schema).parquet(f"{folder}/out").where("path <> 'clock'").select("path", "generation", "text")


def index_after_changes(spark, sf_dir):
    """The fingerprint index after all documents were put in, some were edited and some deleted."""
    files, edited, gone = changes(spark, sf_dir)
    index = CloneIndex(spark, shared_folder(spark, "index"), buckets=8)
    index.apply(clones.token_arrays(files))
    index.apply(clones.token_arrays(edited), files.where("path LIKE 'src2%/fr/%'").select("path"))
    return index.fingerprints().select("path", "pos", "hash")


def affected_after_change(spark, sf_dir):
    """Files whose blocks may have changed with the edits."""
    files, edited, _ = changes(spark, sf_dir)
    index = CloneIndex(spark, shared_folder(spark, "index"), buckets=8)
    index.apply(clones.token_arrays(files))
    return index.apply(clones.token_arrays(edited))


def _kept_rollups(spark, sf_dir) -> KeptRollups:
    files, edited, gone = changes(spark, sf_dir)
    scores = lambda f, g: score_measured(generic.measure_generic(f, MARKERS).withColumn("tier", F.lit(2)), LIMITS).withColumn("generation", F.lit(g))
    rollups = KeptRollups(spark, shared_folder(spark, "rollups"), 8)
    rollups.apply(scores(files, 1))
    rollups.apply(scores(edited, 2), gone)
    return rollups


def folders_after_changes(spark, sf_dir):
    return _kept_rollups(spark, sf_dir).folders().drop("files")


def corpus_after_changes(spark, sf_dir):
    return _kept_rollups(spark, sf_dir).corpus()


def cached_measurements(spark, sf_dir):
    """Lines of code by content, after all documents were cached twice."""
    files = cache.with_key(document_files(spark, sf_dir))
    measured = generic.measure_generic(files, MARKERS).select("content_key", "lines", "sloc")
    folder = shared_folder(spark, "cache")
    cache.append(measured, folder)
    cache.append(measured, folder)
    return cache.read(spark, folder)


def heavy_tokens(spark, sf_dir):
    """Token ids that occur very often, and how often, from bounded summaries and an exact count."""
    ids = clones.token_arrays(document_files(spark, sf_dir)).select(F.explode("ids").alias("id"))
    return heavy_keys(ids, "id", HEAVY).select(F.col("key").alias("token_id"), "n")


_QUIET_SQL = f"""WITH x AS (SELECT 'user/' || user_id AS path, event_id AS generation, event_type AS text, epoch_ms(ts) AS t, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT path, generation, text FROM x WHERE nx IS NULL OR nx - t >= {QUIET_MS}"""
QUERIES = {
    "debounced_events": (debounced_events, _QUIET_SQL),
    "debounced_event_stream": (debounced_event_stream, _QUIET_SQL),
    "index_after_changes": (index_after_changes, f"WITH {after_changes(PRINTS_SQL)} SELECT * FROM prints"),
    "affected_after_change": (affected_after_change, f"""WITH {PRINTS_SQL}, {EDITED_SQL.replace(' WHERE NOT', ' WHERE TRUE OR NOT')}, old AS (SELECT path, hash FROM prints),
        {PRINTS_SQL.replace(FILES_SQL, FILES_SQL.replace('FROM documents', 'FROM edited')).replace('files AS', 'files2 AS').replace('FROM files', 'FROM files2').replace('split AS', 'split2 AS').replace('FROM split', 'FROM split2').replace('lines AS', 'lines2 AS').replace('FROM lines', 'FROM lines2').replace('code AS', 'code2 AS').replace('FROM code', 'FROM code2').replace('per_line AS', 'per_line2 AS').replace('FROM per_line', 'FROM per_line2').replace('tokens AS', 'tokens2 AS').replace('FROM tokens', 'FROM tokens2').replace('vocabulary AS', 'vocabulary2 AS').replace('JOIN vocabulary', 'JOIN vocabulary2').replace('arrays AS', 'arrays2 AS').replace('FROM arrays', 'FROM arrays2').replace('grams AS', 'grams2 AS').replace('FROM grams', 'FROM grams2').replace('windows AS', 'windows2 AS').replace('FROM windows', 'FROM windows2').replace('prints AS', 'prints2 AS').replace('FROM prints', 'FROM prints2').replace('kept AS', 'kept2 AS')},
        own AS (SELECT hash FROM old WHERE path LIKE 'src1%' UNION SELECT hash FROM prints2 WHERE path LIKE 'src1%')
        SELECT path FROM old WHERE hash IN (SELECT hash FROM own) UNION SELECT path FROM files WHERE path LIKE 'src1%'"""),
    "folders_after_changes": (folders_after_changes, f"WITH {after_changes(SCORES_SQL)} " + scored_sums("SELECT folder, sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc FROM (SELECT debt_minutes, sloc, unnest([string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/')]) AS folder FROM scores) GROUP BY folder")),
    "corpus_after_changes": (corpus_after_changes, f"WITH {after_changes(SCORES_SQL)} " + scored_sums("SELECT sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc, count(*) AS files FROM scores")),
    "cached_measurements": (cached_measurements, f"WITH {SCORES_SQL} SELECT DISTINCT sha256('{cache.ENGINE_VERSION}' || chr(0) || 'tier2:prose' || chr(0) || text) AS content_key, lines::INT AS lines, sloc::INT AS sloc FROM scores JOIN files USING (path)"),
    "heavy_tokens": (heavy_tokens, f"WITH {TOKENS_SQL}, v AS (SELECT token, {FNV_SQL} AS id FROM (SELECT DISTINCT token FROM tokens)) SELECT id AS token_id, count(*) AS n FROM tokens JOIN v USING (token) GROUP BY id HAVING count(*) >= {HEAVY}"),
}
