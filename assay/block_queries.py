"""Queries of single blocks: files, labels, filters, sets, arrays, dates, checks, registries; with their SQL."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import gate, metrics, pareto, stats, trials, votes
from .plans import views
from .plans.shared import folder, small_batches, table
from .plans.views import sql
from .queries import BAD, BASE, HIT, PROBE, RATE, VOTED, _probe, _voted, query
from .sources import files, remote, sheets
from .streaming import runs as streams
from .study_queries import PAIR, QUADRANT, _n


def _docs(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return views.read(s, d, "documents").select("doc_id", *columns)


def _k(n: int, name: str = "doc_id") -> Column:
    return F.col(name) % n


# --- files -----------------------------------------------------------------------------


@query("SRC3_json_documents", sql("units") + "SELECT 'array' AS form, human, count(*) AS n FROM units WHERE doc_id % 2 = 0 GROUP BY human UNION ALL SELECT 'keyed', human, count(*) FROM units WHERE doc_id % 2 = 1 GROUP BY human")
def src3(s: SparkSession, d: str) -> DataFrame:
    a, b = folder(s, "arrays"), folder(s, "keyed")
    u = views.units(s, d).withColumn("part", F.floor(F.col("doc_id") / 64))  # a document of up to 64 units a line
    listed = u.filter("doc_id % 2 = 0").groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "human"))).alias("value"))
    listed.select("value").write.text(a)
    keyed = u.filter("doc_id % 2 = 1").groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("human"))))).alias("value"))
    keyed.select("value").write.text(b)
    one = files.json_array(s, a, "id string, human string").select(F.lit("array").alias("form"), "human")
    two = files.keyed_json(s, b, "struct<human: string>", lines=True).select(F.lit("keyed").alias("form"), "human")
    return one.unionByName(two).groupBy("form", "human").agg(_n())


@query("SRC4_labels", sql("units") + "SELECT id, human FROM units WHERE doc_id % 7 <> 3")
def src4(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "labels")
    u = views.units(s, d).withColumns({"part": F.floor(F.col("doc_id") / 64), "label": F.when(_k(7) == 3, "?").otherwise(F.col("human"))})
    named = F.when(_k(4) == 0, F.struct("id", F.col("label").alias("human_label"), F.lit(None).cast("string").alias("human"))).otherwise(F.struct("id", F.lit(None).cast("string").alias("human_label"), F.col("label").alias("human")))
    u.filter("doc_id % 2 = 0").groupBy("part").agg(F.to_json(F.collect_list(named)).alias("value")).select("value").write.text(at)
    u.filter("doc_id % 2 = 1").groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "label")))).alias("value")).select("value").write.mode("append").text(at)
    return files.labels(s, at, lines=True)


@query("SRC5_sheet_by_place", sql("units") + "SELECT id, human, 'memo ' || doc_id % 5 AS memo FROM units WHERE human IN ('S', 'C', 'I')")
def src5(s: SparkSession, d: str) -> DataFrame:
    rows = sheets.by_position(sheets.cells(s, _book(s, d)), id=0, human=6, memo=7)
    return rows.filter(F.col("human").isin("S", "C", "I")).select("id", "human", "memo")


@query("SRC6_sheet_by_header", sql("units") + "SELECT id, human AS human_label, CAST(NULL AS VARCHAR) AS verdict FROM units")
def src6(s: SparkSession, d: str) -> DataFrame:
    return sheets.by_header(sheets.cells(s, _book(s, d)), "id", "human_label", "verdict").drop("path", "row")


def _book(s: SparkSession, d: str) -> str:
    at = folder(s, "books")
    u = views.units(s, d)
    rows = u.select("id", "qid", "arm", F.lit("").alias("c3"), F.lit("").alias("c4"), F.lit("").alias("c5"), F.col("human").alias("human_label"), F.concat(F.lit("memo "), _k(5).cast("string")).alias("memo"))
    sheets.write(rows, at)
    return at


@query("SNK5_blind_sheet", sql("units") + "SELECT id, arm, CAST(NULL AS VARCHAR) AS human_label, 'S,C,I' AS allowed FROM units")
def snk5(s: SparkSession, d: str) -> DataFrame:
    """What a labeller gets: visible columns alone, an empty label column that takes S, C or I."""
    at = folder(s, "blind")
    u = views.units(s, d).select("id", "arm", F.lit("").alias("human_label"), F.col("human").alias("_gold"), F.lit("YES").alias("probe_vote"))
    sheets.write(sheets.blind(u), at, {"human_label": ("S", "C", "I")})
    read = sheets.by_header(sheets.cells(s, at), "id", "arm", "human_label", "_gold", "probe_vote")
    allowed = sheets.choices(s, at)
    return read.filter("_gold is null and probe_vote is null").join(allowed, "path").select("id", "arm", F.nullif("human_label", F.lit("")).alias("human_label"), "allowed")


@query("VA14_blind_leaks", sql("units") + "SELECT arm, name, count(*) AS n FROM units, (SELECT unnest(['_gold', 'Gold', 'judge_v2', 'probe_vote']) AS name) GROUP BY ALL")
def va14(s: SparkSession, d: str) -> DataFrame:
    """Filled cells under headers that would tell a labeller the answer, in the sheets that were written."""
    at = folder(s, "leaky")
    sheets.write(views.units(s, d).select("id", "arm", F.col("human").alias("_gold"), F.col("human").alias("Gold"), F.lit("x").alias("judge_v2"), F.lit("YES").alias("probe_vote"), "qid"), at)
    return sheets.leaking(sheets.cells(s, at), "arm").groupBy("arm", "name").agg(_n())


@query("SRC8_text_tree", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id % 3 <> 0 GROUP BY lang")
def src8(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "tree")
    lines = views.read(s, d, "documents").filter("lang is not null and source is not null").select("lang", F.concat("source", F.lit(" "), "doc_id").alias("value"), "doc_id")
    lines.filter("doc_id % 3 <> 0").drop("doc_id").write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(f"{at}/docs")
    lines.filter("doc_id % 3 = 0").drop("doc_id").write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(f"{at}/.git/objects")
    found = files.texts(s, at, "*.txt")
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg(F.sum(F.regexp_count("text", F.lit("\n"))).cast("long").alias("n"))


@query("SNK1_json_document", VOTED + f"SELECT candidate, '{{\"candidate\":\"' || candidate || '\",\"counts\":{{\"n_flagged\":' || count(*) FILTER ({HIT}) || ',\"n_units\":' || count(*) || '}},\"note\":\"문항\"}}' AS document FROM votes GROUP BY candidate")
def snk1(s: SparkSession, d: str) -> DataFrame:
    """A document per candidate: keys in order, other scripts kept, no time in it, so equal results are equal bytes."""
    at = folder(s, "documents")
    c = metrics.counts(_voted(s, d), ["candidate"])
    files.write_documents(c.select("candidate", F.struct("candidate", F.struct("n_flagged", "n_units").alias("counts"), F.lit("문항").alias("note")).alias("document")), at)
    return files.documents(s, at).select("candidate", "document")


@query("SNK2_appended_lines", BASE + "SELECT run, label, count(*) AS n FROM runs GROUP BY ALL")
def snk2(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "lines")
    rows = views.judge_runs(s, d).select("id", F.col("run").cast("string").alias("run"), "label")
    for run in ("1", "2", "3"):
        files.append_json_lines(rows.filter(F.col("run") == run), at)
    return files.json_lines(s, [at]).groupBy(F.col("run").cast("int").alias("run"), "label").agg(_n())


@query("SNK4_keyed_checkpoint", sql("units") + "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS state FROM units")
def snk4(s: SparkSession, d: str) -> DataFrame:
    """A keyed table fed by a stream: what a batch brings replaces what was there under its key."""
    log, at = folder(s, "log"), folder(s, "checkpoint")
    u = views.units(s, d).select("id", "doc_id")
    u.select("id", F.lit("first").alias("state")).write.parquet(log)
    streams.upsert(streams.source(s, log, "id string, state string", 1_000), at, folder(s, "state") + "/1")
    files.put_batch(u.filter("doc_id % 3 = 0").select("id", F.lit("second").alias("state")), at, 1)
    files.compact(s, at, "id string, state string", "id")
    return files.keyed(s, at, "id string, state string", "id")


@query("SNK6_manifest", "WITH a AS (SELECT lang AS key, count(*)::VARCHAR AS v FROM documents WHERE lang IS NOT NULL GROUP BY lang), b AS (SELECT lang AS key, count(*)::VARCHAR AS v FROM documents WHERE lang IS NOT NULL AND doc_id % 9 <> 0 GROUP BY lang) SELECT key, a.v AS before, b.v AS after, key = 'en' AS only_warns FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def snk6(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "manifest")
    docs = views.read(s, d, "documents").filter("lang is not null")
    manifest = lambda x: x.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    files.guard(manifest(docs), at, ("en",))
    return files.guard(manifest(docs.filter("doc_id % 9 <> 0")), at, ("en",))


@query("SNK9_seed_again", sql("ledger") + "SELECT candidate, seq, status FROM ledger WHERE status IS NOT NULL AND seq % 2 = 1")
def snk9(s: SparkSession, d: str) -> DataFrame:
    """A seed takes the place of what was there; later rows are appended."""
    at = folder(s, "seed")
    rows = views.ledger(s, d).select("candidate", "seq", "status").filter("status is not null")
    files.seed_ledger(rows.filter("seq % 2 = 0"), at)
    files.seed_ledger(rows.filter("seq % 4 = 1"), at, overwrite=True)
    files.append_json_lines(rows.filter("seq % 4 = 3"), at)
    return s.read.schema("candidate string, seq long, status string").json(at)


@query("HS2_file_bytes", "SELECT n_nationkey, sha256(n_name || chr(10)) AS h FROM nation")
def hs2(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "names")
    views.read(s, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(at)
    return files.digests(s, at, "*.txt").select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.col("sha256").alias("h"))


@query("SRC10_archives", "SELECT CAST(n_regionkey AS VARCHAR) AS region, n_name AS name, length(n_name) AS n FROM nation")
def src10(s: SparkSession, d: str) -> DataFrame:
    """Members of tar files; fetching them is left to whatever puts files where Spark reads."""
    at = folder(s, "tars")
    names = views.read(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))  # one of the five regions each
    packed = names.select(F.col("n_regionkey").cast("string").alias("key"), F.pandas_udf(_packed, "binary")("names").alias("content"))
    files.write_binary(packed, at, ".tar.gz")
    found = remote.archived(s, at)
    return found.select(F.regexp_extract("archive", "([^/]+)[.]tar[.]gz$", 1).alias("region"), F.regexp_replace("path", "[.]txt$", "").alias("name"), F.length("text").cast("long").alias("n"))


def _packed(lists: pd.Series) -> pd.Series:
    out = []
    for names in lists:
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode="w:gz") as tar:
            for name in names:
                member = tarfile.TarInfo(f"{name}.txt")
                member.size = len(name.encode())
                tar.addfile(member, io.BytesIO(name.encode()))
        out.append(held.getvalue())
    return pd.Series(out, dtype=object)


@query("SRC11_paged_scan", "SELECT CAST(i AS BIGINT) AS place, 'row ' || i AS row FROM (SELECT unnest(range(137)) AS i)")
def src11(s: SparkSession, d: str) -> DataFrame:
    """A service of 137 rows in pages of 10, by an injected fetch."""
    return remote.paged(s, _page, 10, pages_at_once=4)


def _page(offset: int, length: int) -> list[str]:
    return [f"row {i}" for i in range(offset, min(137, offset + length))]


@query("SRC12_commands", "SELECT n_name AS prompt, n_name AS said FROM nation")
def src12(s: SparkSession, d: str) -> DataFrame:
    """Each prompt to a command's standard input; what it prints is the row's answer."""
    return remote.asked(views.read(s, d, "nation").select(F.col("n_name").alias("prompt")), remote.command(["cat"], timeout=20, retries=1))


@query("SNK7_report_lines", VOTED + f"SELECT candidate || '  ' || lpad(count(*) FILTER ({HIT})::VARCHAR, 6, ' ') || ' of ' || lpad(count(*)::VARCHAR, 6, ' ') || ' flagged' AS line FROM votes GROUP BY candidate")
def snk7(s: SparkSession, d: str) -> DataFrame:
    """A report as lines of text, for a console or a file."""
    c = metrics.counts(_voted(s, d), ["candidate"])
    wide = lambda n: F.lpad(F.col(n).cast("string"), 6, " ")
    return c.select(F.concat("candidate", F.lit("  "), wide("n_flagged"), F.lit(" of "), wide("n_units"), F.lit(" flagged")).alias("line"))


@query("SRC9_markdown_profile", "WITH m AS (SELECT doc_id, '# ' || coalesce(source, '') || chr(10) || '## ' || coalesce(lang, '') || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '|---|' || chr(10) ELSE '' END || regexp_replace(coalesce(text, ''), '[#|`!()]|\\[|\\]', ' ', 'g') || '[a](b) ![c](d)' AS md FROM documents) SELECT doc_id, 2 AS headings, len(regexp_extract_all(md, '\\|---\\|')) AS rules, len(string_split(md, chr(10))) AS lines, length(md) AS chars FROM m")
def src9b(s: SparkSession, d: str) -> DataFrame:
    md = F.expr("'# ' || coalesce(source, '') || '\n' || '## ' || coalesce(lang, '') || '\n' || CASE WHEN doc_id % 3 = 0 THEN '|---|' || '\n' ELSE '' END")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#|`!()]|\[|\]", " ")
    m = views.read(s, d, "documents").select("doc_id", F.concat(md, body, F.lit("[a](b) ![c](d)")).alias("md")).withColumn("p", text.profile(F.col("md")))
    return m.select("doc_id", F.size("p.levels").alias("headings"), F.col("p.rules").cast("long").alias("rules"), F.size(F.split("md", "\n", -1)).cast("long").alias("lines"), F.length("md").cast("long").alias("chars"))


# --- projections, filters, joins -------------------------------------------------------


@query("PRJ4_evidence_sets", """WITH cited AS (SELECT DISTINCT user_id % 500 AS claim, event_id % 11 AS doc FROM events), e AS (SELECT user_id % 500 AS claim, event_id % 11 AS doc, event_type FROM events WHERE event_type IN ('purchase', 'click') AND event_id % 3 = 0)
SELECT c.claim, c.doc, CASE WHEN count(e.event_type) = 0 THEN 'I' WHEN bool_or(e.event_type = 'purchase') THEN 'S' ELSE 'C' END AS human FROM cited c LEFT JOIN e ON c.claim = e.claim AND c.doc = e.doc GROUP BY c.claim, c.doc""")
def prj4(s: SparkSession, d: str) -> DataFrame:
    """Per claim and cited document: S with any supporting evidence, C with other evidence only, I with none."""
    e = views.read(s, d, "events").select((F.col("user_id") % 500).alias("claim"), (F.col("event_id") % 11).alias("doc"), "event_type", "event_id")
    evidence = e.filter("event_type in ('purchase', 'click') and event_id % 3 = 0").select("claim", "doc", (F.col("event_type") == "purchase").alias("supports"))
    return trials.evidence_labels(e.select("claim", "doc"), evidence, ["claim", "doc"])


@query("PRJ5_public_columns", "SELECT doc_id, lang, length(coalesce(text, '')) AS n FROM documents")
def prj5(s: SparkSession, d: str) -> DataFrame:
    private = views.read(s, d, "documents").select("doc_id", "lang", F.col("text").alias("_text"), F.col("source").alias("_source"))
    return sheets.public(private.withColumn("n", F.length(F.coalesce("_text", F.lit("")))))


@query("PRJ8_stable_yes", PROBE + f""", v AS (SELECT id, human, string_agg('run' || run || ':' || vote, ' | ' ORDER BY run) AS reasons, count(*) FILTER (vote = 'YES') AS yes FROM probe GROUP BY ALL)
SELECT v.id, CASE WHEN {BAD} THEN 'TRUE_HIT' ELSE 'FALSE_ALARM' END AS kind, reasons, sha256(coalesce(d.text, '')) AS evidence FROM v JOIN units u USING (id) JOIN documents d USING (doc_id) WHERE yes = 3""".replace("WHEN human", "WHEN v.human"))
def prj8(s: SparkSession, d: str) -> DataFrame:
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "vote"))), lambda r: F.concat(F.lit("run"), r["run"].cast("string"), F.lit(":"), r["vote"])), " | ")
    p = _probe(s, d).groupBy("id", "doc_id", "human").agg(reasons.alias("reasons"), metrics.number(F.col("vote") == "YES").alias("yes")).filter("yes = 3")  # three runs
    kind = F.when(metrics.problem(), "TRUE_HIT").otherwise("FALSE_ALARM")
    return p.join(_docs(s, d, "text"), "doc_id").select("id", kind.alias("kind"), "reasons", F.sha2(F.coalesce("text", F.lit("")), 256).alias("evidence"))


MEMO = "coalesce(source, '') || CASE WHEN doc_id % 4 = 0 THEN ' 명제없음' WHEN doc_id % 4 = 1 THEN ' 명제 없음' ELSE '' END"


@query("FLT2_has_proposition", f"SELECT doc_id FROM (SELECT doc_id, {MEMO} AS memo FROM documents) WHERE NOT contains(memo, '명제없음')")
def flt2(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d, "source").withColumn("memo", F.expr(MEMO)).filter(trials.has_proposition(F.col("memo"))).select("doc_id")


@query("FLT3_problem_and_flagged", VOTED + f"SELECT candidate, id, {BAD} AS problem, {HIT} AS flagged FROM votes")
def flt3(s: SparkSession, d: str) -> DataFrame:
    return _voted(s, d).select("candidate", "id", metrics.problem().alias("problem"), votes.flagged("maj").alias("flagged"))


@query("FLT5_targets", sql("units") + ", c AS (SELECT *, count(*) OVER (PARTITION BY doc_id // 3) - 1 AS n_siblings FROM units) SELECT id FROM c WHERE qid NOT IN ('Q003', 'Q007') OR n_siblings = 0")
def flt5(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d).withColumn("answer", F.floor(F.col("doc_id") / 3))
    sib = u.groupBy("answer").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    return u.join(sib, "answer").filter(~F.col("qid").isin("Q003", "Q007") | (F.col("n_siblings") == 0)).select("id").orderBy("id")


@query("FLT9_to_do", sql("units") + "SELECT id FROM units WHERE qid IN ('Q001', 'Q002', 'Q003', 'Q004') AND doc_id % 3 <> 0 ORDER BY id LIMIT 7")
def flt9(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d)
    return trials.to_do(u, "id", u.filter("doc_id % 3 = 0"), only=("qid", ("Q001", "Q002", "Q003", "Q004")), limit=7).select("id")


@query("JN17_pair_units", PAIR.replace("SELECT a.qid,", "SELECT a.id, a.qid,") + f" SELECT id, qid, human, {QUADRANT} AS quadrant FROM p")
def jn17(s: SparkSession, d: str) -> DataFrame:
    v = _voted(s, d)
    one, two = (v.filter(F.col("candidate") == c).select("id", "qid", "human", votes.short("maj").alias("said")) for c in ("c005", "c006"))
    return trials.pair_units(one, two)


@query("JN17_target_cluster", PAIR + f" SELECT qid, n FROM (SELECT qid, count(*) AS n FROM p WHERE {QUADRANT} = 'BOTH_FAIL' GROUP BY qid) ORDER BY n DESC, qid LIMIT 1")
def jn17b(s: SparkSession, d: str) -> DataFrame:
    """Where both fail most: the question that the next variant aims at; none if they never fail together."""
    return jn17(s, d).filter("quadrant = 'BOTH_FAIL'").groupBy("qid").agg(_n()).orderBy(F.desc("n"), "qid").limit(1)


@query("AG1_rows_by_id", BASE + "SELECT candidate, id, string_agg(run || ':' || label, ',' ORDER BY run) AS votes FROM runs GROUP BY candidate, id")
def ag1(s: SparkSession, d: str) -> DataFrame:
    return votes.listed(views.judge_runs(s, d), ["candidate", "id"], "run", "label").withColumn("votes", F.array_join(F.transform("votes", lambda v: F.concat_ws(":", v["run"].cast("string"), v["label"])), ","))


@query("AG28_base_rate_per_set", VOTED + f"""SELECT CASE WHEN qid IN ('Q003', 'Q007', 'Q011') THEN 'exploratory' ELSE 'confirmatory' END AS part, count(*) AS n, count(*) FILTER ({HIT}) AS problem, {RATE.format(a=f'count(*) FILTER ({HIT})', b='count(*)')} AS rate, count(*) FILTER (maj = 'SPLIT') AS split, count(*) FILTER ({HIT}) AS improvement_ceiling
FROM votes WHERE candidate = 'c005' GROUP BY 1""")
def ag28(s: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("qid").isin("Q003", "Q007", "Q011"), "exploratory").otherwise("confirmatory")
    return trials.base_rates(_voted(s, d).filter("candidate = 'c005'").withColumn("part", part), ["part"])


@query("WN9_line_numbers", "SELECT doc_id, length(left(text, instr(text, 'the ') - 1)) - length(replace(left(text, instr(text, 'the ') - 1), chr(10), '')) + 1 AS line FROM documents WHERE contains(text, 'the ')")
def wn9(s: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", F.lit("the "))
    return _docs(s, d, "text").filter(at > 0).select("doc_id", text.line_of(F.col("text"), at).cast("long").alias("line"))


@query("TK6_sorted_ids", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id")
def tk6(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("TK8_prefix", sql("units") + "SELECT id FROM units ORDER BY sha256('7' || id) LIMIT 55")
def tk8(s: SparkSession, d: str) -> DataFrame:
    return trials.shuffled(views.units(s, d), "id", "7").limit(55).select("id")


@query("SA15_seeded_sample", sql("units") + ", r AS (SELECT id, human, row_number() OVER (PARTITION BY human ORDER BY sha256('20260730' || id)) AS rk FROM units) SELECT id, human FROM r WHERE rk <= 9")
def sa15(s: SparkSession, d: str) -> DataFrame:
    """Order by a keyed hash: the same seed gives the same order in any engine (another one than a generator's shuffle)."""
    return trials.sample(views.units(s, d), "id", "20260730", "human", 9).select("id", "human")


@query("SA16_blind_order", sql("units") + "SELECT id, arm FROM units")
def sa16(s: SparkSession, d: str) -> DataFrame:
    """Judge tasks in an order that tells nothing, another one in each run; the rows are all of them."""
    return views.units(s, d).select("id", "arm").orderBy(F.rand())


# --- sets ------------------------------------------------------------------------------


def _sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = views.units(s, d)
    return u.filter("doc_id % 3 = 0").select("qid").distinct(), u.filter("human = 'C'").select("qid").distinct()


SETS = sql("units") + ", a AS (SELECT DISTINCT qid FROM units WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT qid FROM units WHERE human = 'C')"


@query("ST1_union_of_parts", "SELECT doc_id, 1 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 0")
def st1(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return docs.filter("doc_id % 2 = 0").withColumn("part", F.lit(1)).unionByName(docs.filter("doc_id % 3 = 0").withColumn("part", F.lit(2)))


@query("ST5_symmetric_difference", SETS + " SELECT qid, a.qid IS NOT NULL AS in_first FROM a FULL JOIN b USING (qid) WHERE a.qid IS NULL OR b.qid IS NULL")
def st5(s: SparkSession, d: str) -> DataFrame:
    a, b = _sets(s, d)
    both = a.withColumn("one", F.lit(True)).join(b.withColumn("two", F.lit(True)), "qid", "full_outer")
    return both.filter("one is null or two is null").select("qid", F.col("one").isNotNull().alias("in_first"))


@query("ST6_assertions", SETS + " SELECT (SELECT count(*) FROM b ANTI JOIN a USING (qid)) = 0 AS subset, (SELECT count(*) FROM b ANTI JOIN a USING (qid)) + (SELECT count(*) FROM a ANTI JOIN b USING (qid)) = 0 AS equal")
def st6(s: SparkSession, d: str) -> DataFrame:
    return trials.set_relation(*_sets(s, d), "qid")


@query("ST7_overlap", "SELECT doc_id, list_has_any(CASE WHEN doc_id % 5 = 0 THEN [] ELSE [doc_id % 7, doc_id % 4] END, [doc_id % 3, doc_id % 10]) AS meets FROM documents")
def st7(s: SparkSession, d: str) -> DataFrame:
    cited = F.when(_k(5) == 0, F.array().cast("array<long>")).otherwise(F.array(_k(7), _k(4)))
    return _docs(s, d).select("doc_id", F.arrays_overlap(cited, F.array(_k(3), _k(10))).alias("meets"))


@query("ST8_distinct_in_order", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, coalesce(role, '?') AS role, min(turn) AS turn FROM conversations GROUP BY ALL) GROUP BY conv_id")
def st8(s: SparkSession, d: str) -> DataFrame:
    first = views.read(s, d, "conversations").groupBy("conv_id", F.coalesce("role", F.lit("?")).alias("role")).agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ",").alias("roles"))


# --- values ----------------------------------------------------------------------------


OBJECT = "CASE doc_id % 6 WHEN 0 THEN '34(2)' WHEN 1 THEN ' ' || (doc_id % 97) || 'A (가)' WHEN 2 THEN (doc_id % 97) || '(1) and more' WHEN 3 THEN '' WHEN 4 THEN '7' ELSE ' 12 ' END"
SUB = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || (doc_id % 5) || ' ' ELSE '9' END"
STANDARD = "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE ' 10' || (doc_id % 90 + 10) END"


@query("FN4_cited_object", f"""WITH o AS (SELECT doc_id, trim({STANDARD}) AS s, trim({OBJECT}) AS p, trim({SUB}) AS q FROM documents), x AS (SELECT *, regexp_full_match(p, '[0-9]+[A-Za-z]?\\s*\\([^)]+\\)') AS whole, s <> '' AND p <> '' AS ok FROM o)
SELECT doc_id, CASE WHEN ok THEN s END AS standard, CASE WHEN ok THEN CASE WHEN whole THEN regexp_extract(p, '^([0-9]+[A-Za-z]?)', 1) ELSE p END END AS paragraph, CASE WHEN ok THEN coalesce(nullif(q, ''), CASE WHEN whole THEN regexp_extract(p, '\\(([^)]+)\\)', 1) END) END AS subitem FROM x""")
def fn4(s: SparkSession, d: str) -> DataFrame:
    c = text.cited_object(F.expr(STANDARD), F.expr(OBJECT), F.expr(SUB))
    return _docs(s, d).select("doc_id", *[c[k].alias(k) for k in ("standard", "paragraph", "subitem")])


REWRITES = (("regex", "[0-9]{3,}", "N"), ("text", "the ", "THE "), ("regex", r"\s+$", ""))


@query("FN25_rewrite_chain", "SELECT doc_id, sha256(regexp_replace(replace(regexp_replace(t, '[0-9]{3,}', 'N', 'g'), 'the ', 'THE '), '\\s+$', '', 'g')) AS h, CASE WHEN NOT regexp_matches(t, '[0-9]{3,}') THEN 0 WHEN NOT contains(regexp_replace(t, '[0-9]{3,}', 'N', 'g'), 'the ') THEN 1 WHEN NOT regexp_matches(replace(regexp_replace(t, '[0-9]{3,}', 'N', 'g'), 'the ', 'THE '), '\\s+$') THEN 2 ELSE -1 END AS missing FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END AS t FROM documents)")
def fn25(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", ""), F.when(_k(3) == 0, " ").otherwise(""))
    done = _docs(s, d, "text").select("doc_id", text.rewritten(t, REWRITES).alias("r"))
    return done.select("doc_id", F.sha2("r.text", 256).alias("h"), F.coalesce("r.missing", F.lit(-1)).alias("missing"))


@query("FN26_number_after", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(t, 'recall = ([0-9]+[.][0-9]+)', 1), '') AS DOUBLE) AS number FROM (SELECT doc_id, coalesce(source, '') || CASE WHEN doc_id % 4 <> 0 THEN ' recall = ' || (doc_id % 10) || '.' || (doc_id % 97) ELSE ' recall is high' END AS t FROM documents)")
def fn26(s: SparkSession, d: str) -> DataFrame:
    said = F.when(_k(4) != 0, F.concat(F.lit(" recall = "), _k(10).cast("string"), F.lit("."), _k(97).cast("string"))).otherwise(" recall is high")
    return _docs(s, d, "source").select("doc_id", text.number_after(F.concat(F.coalesce("source", F.lit("")), said), "recall = ").alias("number"))


@query("FN27_truncated", "SELECT doc_id, left(text, 60) AS shown, length(text) > 60 AS cut FROM documents")
def fn27(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d, "text").select("doc_id", F.substring("text", 1, 60).alias("shown"), (F.length("text") > 60).alias("cut"))


@query("JS4_loose_claims", """SELECT doc_id AS question_id, CASE doc_id % 4 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'c' || doc_id WHEN 2 THEN 'c1' ELSE '7' END AS claim_id, 'said ' || doc_id AS text, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 5 = 4 THEN 0 ELSE 1 END AS INTEGER) AS n_citations FROM documents""")
def js4(s: SparkSession, d: str) -> DataFrame:
    """Claims under either name of a key, one citation or a list, text or object."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    key = F.when(_k(4) == 0, F.concat(F.lit('"id": "c'), n, F.lit('", '))).when(_k(4) == 1, F.concat(F.lit('"id": "", "claim_id": "c'), n, F.lit('", '))).when(_k(4) == 2, F.lit("")).otherwise('"claim_id": 7, ')
    said = F.concat(F.when(k % 2 == 0, '"text": "said ').otherwise('"statement": "said '), n, F.lit('"'))
    cite = F.when(_k(5) == 0, '"citations": ["1002 문단 1", {"standard": 1002, "paragraph": 2}]').when(_k(5) == 1, '"citation": "1002 문단 1"').when(_k(5) == 2, '"citations": {"standard": "1002", "paragraph": "3"}').when(_k(5) == 3, '"citation": ["1002 문단 1"]').otherwise('"citations": null')
    raw = F.concat(F.lit('{"answer": "a", "claims": [{'), key, said, F.lit(", "), cite, F.lit("}]}"))
    c = gate.claims(gate.parse(_docs(s, d).select(k.alias("question_id"), raw.alias("raw"))))
    return c.select("question_id", "claim_id", "text", F.size("locators").alias("n_citations"))


@query("AR3_nested_defaults", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, 'none') AS value FROM documents")
def ar3(s: SparkSession, d: str) -> DataFrame:
    inner = F.when(_k(2) == 0, F.struct(F.struct(F.col("lang").alias("value")).alias("axis")))
    other = F.when(_k(3) == 0, F.struct(F.col("source").alias("value")))
    r = _docs(s, d, "lang", "source").select("doc_id", inner.alias("objectives"), other.alias("spare"))
    return r.select("doc_id", F.coalesce("objectives.axis.value", "spare.value", F.lit("none")).alias("value"))


@query("AR4_appended_history", "SELECT conv_id, count(*) + 1 AS n, 'PRUNED' AS status, coalesce(arg_max(coalesce(role, '?'), turn), '?') AS before FROM conversations GROUP BY conv_id")
def ar4(s: SparkSession, d: str) -> DataFrame:
    """A record's copy with one entry more; the entries before it stay."""
    entry = F.struct(F.col("turn").cast("string").alias("at"), F.coalesce("role", F.lit("?")).alias("status"), F.lit("log").alias("by"))
    held = views.read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("h"))  # a conversation's turns
    r = held.select("conv_id", F.lit("ON_FRONT").alias("status"), F.transform("h", lambda x: x["e"]).alias("status_history"))
    done = pareto.transition(r, "PRUNED", "size", "2026-07-30T00:00:00+09:00")
    return done.select("conv_id", F.size("status_history").cast("long").alias("n"), "status", F.element_at("status_history", -2)["status"].alias("before"))


@query("MA2_ceil_and_clamp", "SELECT doc_id, CAST(ceil(n_chars / 7.0e0) AS BIGINT) AS up, least(500, greatest(90, n_chars)) AS held FROM documents WHERE n_chars IS NOT NULL")
def ma2(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return _docs(s, d, "n_chars").filter(n.isNotNull()).select("doc_id", F.ceil(n / F.lit(7.0)).alias("up"), stats.clamp(n, 90, 500).alias("held"))


@query("DT1_fixed_offset", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS at FROM events")
def dt1(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "events").select("event_id", text.iso_time(F.col("ts")).alias("at"))


@query("DT2_elapsed", "SELECT user_id, round_even(date_diff('millisecond', min(ts), max(ts)) / 1000.0e0, 1) AS elapsed FROM events GROUP BY user_id")
def dt2(s: SparkSession, d: str) -> DataFrame:
    t = views.read(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.select("user_id", F.bround(F.timestamp_diff("MILLISECOND", F.col("a"), F.col("b")) / F.lit(1000.0), 1).alias("elapsed"))


# --- checks and injected functions -----------------------------------------------------


@query("VA5_fail_closed", r"""WITH r AS (SELECT doc_id, CASE WHEN contains(text, '@') THEN 'verifier_timeout' WHEN text IS NULL OR NOT regexp_matches(text, '[a-z]') THEN 'internal_error' WHEN length(text) % 2 = 1 THEN 'schema_invalid' END AS reason FROM documents)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'VERIFIED' ELSE 'INDETERMINATE' END AS verdict FROM r""")
def va5(s: SparkSession, d: str) -> DataFrame:
    """A check of whole texts that runs out of time on some and breaks on others."""
    found = _docs(s, d, "text").select(F.col("doc_id").alias("question_id"), F.pandas_udf(gate.fail_closed(_check), "array<string>")("text").alias("reasons"))
    with small_batches(s):
        found = table(found, "checked")
    verdict = gate.decide(found, found.select("question_id", F.explode("reasons").alias("reason")))
    return found.join(verdict, "question_id").select(F.col("question_id").alias("doc_id"), F.get("reasons", F.lit(0)).alias("reason"), "verdict")


def _check(x: str) -> list[str]:
    if "@" in x:
        raise TimeoutError
    next(c for c in x if "a" <= c <= "z")  # a text without letters breaks it
    return ["schema_invalid"] if len(x) % 2 else []


@query("VA7_injected_judge", r"""WITH w AS (SELECT doc_id AS question_id, text, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'the', ''))) // 3 AS n FROM documents)
SELECT question_id, CASE WHEN text IS NULL OR text = '' THEN 'UNRESOLVED' WHEN contains(text, 'http') THEN 'UNRESOLVED' WHEN n > 20 THEN 'SUPPORTED' WHEN n > 5 THEN 'CONTRADICTED' ELSE 'UNRESOLVED' END AS label FROM w""")
def va7(s: SparkSession, d: str) -> DataFrame:
    """A judge that reads the whole text: it fails on some, and says what is no label of others."""
    kept = _docs(s, d, "text").select(F.col("doc_id").alias("question_id"), F.lit("c1").alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"))
    return gate.judge_claims(kept, _judge).select("question_id", "label")


def _judge(prompt: str, claim_id: str) -> str:
    if "http" in prompt:
        raise ValueError(claim_id)
    n = prompt.count("the")
    return "SUPPORTED" if n > 20 else "CONTRADICTED" if n > 5 else "maybe"


@query("VA8_reasons", BASE + "SELECT label, CASE label WHEN 'CONTRADICTED' THEN 'semantic_contradicted' WHEN 'INSUFFICIENT' THEN 'semantic_insufficient' WHEN 'SUPPORTED' THEN NULL ELSE 'semantic_unresolved' END AS reason, count(*) AS n FROM runs GROUP BY label")
def va8(s: SparkSession, d: str) -> DataFrame:
    return views.judge_runs(s, d).groupBy("label").agg(_n()).select("label", gate.reason_of(F.col("label")).alias("reason"), "n")


@query("VA11_validity", "WITH seen AS (SELECT DISTINCT 'h' || doc_id % 50 AS h FROM documents WHERE doc_id % 50 < 9), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'm' END AS model, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'h' || doc_id % 50 END AS h, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'unit' END AS b FROM documents)\nSELECT 'c' || doc_id AS candidate, concat_ws(',', CASE WHEN model <> 'm' THEN 'model' END, CASE WHEN c.h IS NULL THEN 'no_prompt' END, CASE WHEN s.h IS NOT NULL THEN 'prompt_again' END, CASE WHEN b = 'unknown' THEN 'builder' END) AS faults FROM c LEFT JOIN seen s ON c.h = s.h")
def va11(s: SparkSession, d: str) -> DataFrame:
    from .operators.prompts import BUILDERS
    sha = F.concat(F.lit("h"), _k(50).cast("string"))
    docs = _docs(s, d)
    new = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate"), F.when(_k(7) == 0, "other").otherwise("m").alias("model"), F.when(_k(11) != 0, sha).alias("prompt_sha256"), F.when(_k(5) == 0, "unknown").otherwise("unit").alias("builder"))
    found = pareto.faults(new, docs.filter("doc_id % 50 < 9").select(sha.alias("prompt_sha256")), "m", BUILDERS)
    return found.select("candidate", F.array_join("faults", ",").alias("faults"))


@query("UD3_named_predicates", VOTED + f"SELECT candidate, rule, count(*) FILTER (ok) AS n FROM (SELECT candidate, unnest(['problem', 'flagged', 'detected', 'split']) AS rule, unnest([{BAD}, {HIT}, {BAD} AND {HIT}, maj = 'SPLIT']) AS ok FROM votes) GROUP BY ALL")
def ud3(s: SparkSession, d: str) -> DataFrame:
    one = [F.struct(F.lit(name).alias("rule"), rule().alias("ok")) for name, rule in metrics.RULES.items()]
    x = _voted(s, d).select("candidate", F.explode(F.array(*one)).alias("r"))
    return x.groupBy("candidate", F.col("r.rule").alias("rule")).agg(metrics.number(F.col("r.ok")).alias("n"))


@query("UD4_axis_functions", VOTED + f"SELECT candidate, {RATE.format(a=f'count(*) FILTER ({BAD} AND {HIT})', b=f'count(*) FILTER ({BAD})')} AS recall, {RATE.format(a=f'count(*) FILTER ({BAD} AND {HIT})', b=f'count(*) FILTER ({HIT})')} AS precision FROM votes GROUP BY candidate")
def ud4(s: SparkSession, d: str) -> DataFrame:
    return _voted(s, d).groupBy("candidate").agg(*[F.bround(axis(), 4).alias(name) for name, axis in metrics.AXES.items()])


@query("SP3_budget_order", "SELECT round, kind FROM (SELECT o_orderkey % 40 AS round, unnest(['filter_strip', 'S1', 'S2', 'S3']) AS kind, unnest([1, 2, 3, 4]) AS place, max(o_orderkey % 7) * 100 AS budget FROM orders GROUP BY o_orderkey % 40) WHERE place * 165 <= budget")
def sp3(s: SparkSession, d: str) -> DataFrame:
    """Slots that a round's budget of calls pays for: what takes away comes first, the pair of endpoints goes first."""
    rounds = views.read(s, d, "orders").groupBy((F.col("o_orderkey") % 40).alias("round")).agg((F.max(F.col("o_orderkey") % 7) * 100).alias("budget"))
    return trials.affordable(rounds, F.col("budget")).select("round", "kind")


@query("SP5_random_parent", "WITH RECURSIVE g(i, s) AS (SELECT 0, 20260731::HUGEINT UNION ALL SELECT i + 1, (s * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT FROM g WHERE i < 30) SELECT CAST(i - 1 AS BIGINT) AS round, 'c' || lpad(CAST(((s // 131072) * 12) // 140737488355328 AS VARCHAR), 3, '0') AS parent FROM g WHERE i > 0")
def sp5(s: SparkSession, d: str) -> DataFrame:
    pool = views.judge_runs(s, d).select("candidate").distinct()
    return trials.random_parents(pool, "candidate", 30)


@query("SP7_scalar_against_front", VOTED.rstrip() + f""", m AS (SELECT candidate, {RATE.format(a=f'count(*) FILTER ({BAD} AND {HIT})', b=f'count(*) FILTER ({BAD})')} AS score, count(*) FILTER ({HIT}) AS cost FROM votes GROUP BY candidate), b AS (SELECT score AS s0, cost AS c0 FROM m WHERE candidate = 'c004')
SELECT candidate, score > s0 AS scalar, score >= s0 AND cost <= c0 AND (score > s0 OR cost < c0) AS pareto, cost > c0 AS dearer, score <= s0 AND cost > c0 AS inferior FROM m, b WHERE candidate <> 'c004'""")
def sp7(s: SparkSession, d: str) -> DataFrame:
    m = _voted(s, d).groupBy("candidate").agg(F.bround(metrics.AXES["recall"](), 4).alias("score"), metrics.number(votes.flagged("maj")).alias("cost"))
    return trials.two_gates(m, "c004")


@query("SA13_answer_context", PROBE + """, o AS (SELECT id, doc_id, human, count(*) FILTER (vote = 'YES') = 3 AS old FROM probe JOIN units u USING (id, human) GROUP BY ALL), n AS (SELECT *, (doc_id * 17) % 10 < 4 AND old AS new, doc_id % 3 AS siblings FROM o)
SELECT count(*) FILTER (old AND NOT new AND human = 'S') AS flipped, count(*) FILTER (old AND human = 'S') AS false_alarms, count(*) FILTER (old AND new AND human <> 'S') AS kept, count(*) FILTER (old AND human <> 'S') AS hits, count(*) FILTER (old AND NOT new AND human = 'S' AND siblings <= 1) AS solo_flips,
  count(*) FILTER (old AND NOT new AND human = 'S') >= 8 AND count(*) FILTER (old AND human <> 'S') > 0 AND bool_and(new OR NOT old OR human = 'S') AND 0.91 >= 0.9 AS adopted, count(*) FILTER (old AND NOT new AND human = 'S' AND siblings <= 1) = 0 AS attributable FROM n""".replace("JOIN units u USING (id, human)", "JOIN (SELECT id, doc_id FROM units) u USING (id)"))
def sa13(s: SparkSession, d: str) -> DataFrame:
    old = _probe(s, d).groupBy("id", "doc_id", "human").agg((metrics.number(F.col("vote") == "YES") == 3).alias("old"))
    both = old.withColumns({"new": (F.col("doc_id") * 17 % 10 < 4) & F.col("old"), "siblings": _k(3)})
    return trials.answer_context(both, recall=0.91)


@query("SM7_parallel_conditions", BASE + "SELECT candidate, run, count(*) AS n, count(*) FILTER (label = 'UNRESOLVED') = 0 AS clean FROM runs WHERE candidate IN ('c005', 'c006') GROUP BY ALL")
def sm7(s: SparkSession, d: str) -> DataFrame:
    """Both conditions and their three runs in one job: tasks, not processes, run side by side; a status per run."""
    r = views.judge_runs(s, d).filter(F.col("candidate").isin("c005", "c006"))
    return r.groupBy("candidate", "run").agg(_n(), (metrics.number(F.col("label") == "UNRESOLVED") == 0).alias("clean"))
