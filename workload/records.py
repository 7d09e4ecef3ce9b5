"""Sources, ingest, keyed tables, conversations, streams, evaluation and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import evaluation as ev
from loomstone.operators import ingest as ing
from loomstone.operators import inventory as inv
from loomstone.operators import turns as tu
from loomstone.plans.ordered import position_bucket
from loomstone.session import fresh_path, is_folder
from loomstone.sources import files as fi
from loomstone.sources import folders as fo
from loomstone.sources import records as re_
from loomstone.sources import reports as rp
from loomstone.streaming import jobs
from workload.base import HITS_SQL, facts, hits, query, questions, quoted, source, strip_sql, table
from workload.retrieval import SIDES_SQL, both_sides

NL = "chr(10)"

# ---------------------------------------------------------------- listings: the pages' addresses as files

EXTS = [".pdf", ".docx", ".hwp", ".tmp", ".txt", ".xyz"]
MARKS = ["", "_v2", " (1)", "_final", " copy 계약"]
AS_OF = 1_700_000_000


def listing(spark, sf):
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (n % 6 + 1).cast("int"))
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (n % 5 + 1).cast("int"))
    where = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    return p.select(
        "page_id", F.concat(F.lit("/share/"), where, mark, ext).alias("path"), (F.floor(F.length("html") / 1000) * 1000).cast("long").alias("size"),
        (F.lit(AS_OF) - n * 1_000_000).cast("long").alias("mtime"), "html", ext.alias("suffix"))


LISTING = f"""lst AS (SELECT page_id, '/share/' || regexp_extract(url, '^https?://([^?#]+)', 1) || [{', '.join(quoted(m) for m in MARKS)}][page_id % 5 + 1] || [{', '.join(quoted(e) for e in EXTS)}][page_id % 6 + 1] AS path,
  length(html) // 1000 * 1000 AS size, {AS_OF} - page_id * 1000000 AS mtime, html, [{', '.join(quoted(e) for e in EXTS)}][page_id % 6 + 1] AS suffix FROM pages)"""


def files(spark, sf):
    return inv.classified(listing(spark, sf).drop("html", "suffix"), "/share", 2)


FILES = f"""{LISTING}, pt AS (SELECT *, string_split(substr(path, 8), '/') AS parts FROM lst),
fl AS (SELECT page_id, path, size, mtime, parts[-1] AS name, parts[1:len(parts) - 1] AS folders, lower(regexp_extract(parts[-1], '^\\.*[^.].*?(\\.[^.]*)$', 1)) AS ext FROM pt),
fc AS (SELECT *, '/share' || CASE WHEN len(folders) > 0 THEN '/' || array_to_string(folders[1:2], '/') ELSE '' END AS "group",
  CASE WHEN ext IN ('.pdf', '.docx', '.pptx', '.xlsx', '.xlsm', '.txt', '.md') THEN '지원' WHEN ext IN ('.hwp', '.hwpx', '.doc', '.ppt', '.xls') THEN '변환필요' WHEN ext IN ('.lnk', '.tmp', '.ini', '.db', '.ds_store', '.url', '.exe', '.dll') OR ext = '' THEN '무시' ELSE '기타' END AS bucket
  FROM fl WHERE len(list_filter(folders, lambda f: lower(f) IN ('@recycle', 'system volume information') OR left(f, 1) IN ('$', '~', '.'))) = 0)"""

# ---------------------------------------------------------------- sources


@query("scan_folders", """SELECT nullif(lang, '') AS lang, nullif(source, '') AS source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2""")
def scan_folders(spark, sf):
    """The texts as files in folders by language and source, then listed: bytes per folder, one line end a text."""
    path = fresh_path(spark, "folders")
    table(spark, sf, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    found = fo.scan_folders(spark, path, [".txt"])

    def of(name):
        value = F.url_decode(F.regexp_replace(F.regexp_extract("path", f"(?:^|/){name}=([^/]*)/", 1), r"\+", "%2B"))
        return F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__"))

    return found.groupBy(of("lang").alias("lang"), of("source").alias("source")).agg(F.sum("size").alias("bytes"))



# The rules of the scan over the addresses as a listing, every seventh file hidden; tests scan a real folder.
@query("scan_corpus", f"""WITH {LISTING}, h AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(path, '([^/]+)$', '.\\1') ELSE path END AS path, size FROM lst)
SELECT page_id, path, lower(regexp_extract(path, '(\\.[a-z]+)$', 1)) AS suffix, size FROM h
WHERE lower(regexp_extract(path, '(\\.[a-z]+)$', 1)) IN ('.txt', '.md', '.pdf', '.docx', '.xlsx', '.xlsm', '.pptx') AND NOT starts_with(string_split(path, '/')[-1], '.')""")
def scan_corpus(spark, sf):
    hidden = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("path", "([^/]+)$", ".$1")).otherwise(F.col("path"))
    rows = listing(spark, sf).select("page_id", hidden.alias("path"), "size")
    return fi.wanted_files(rows).select("page_id", "path", "suffix", "size")


@query("classify_format", f"WITH {FILES} SELECT page_id, CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.txt' THEN 'txt' ELSE 'unknown' END AS format, ext IN ('.pdf', '.docx', '.txt') AS supported FROM fl")
def classify_format(spark, sf):
    fmt = fi.classify_format(fi.suffix(F.col("path")))
    return listing(spark, sf).select("page_id", fmt.alias("format"), fi.is_supported(fmt).alias("supported"))


@query("file_admission", f"""WITH {LISTING}, c AS (SELECT *, CASE WHEN page_id % 12 = 0 THEN '%PDF-1.7 ' ELSE '' END || html AS content FROM lst)
SELECT page_id, CASE WHEN suffix NOT IN ('.pdf', '.docx', '.txt') THEN 'unsupported_suffix' WHEN strlen(content) > 2000 THEN 'too_large'
  WHEN suffix = '.pdf' AND NOT starts_with(content, '%PDF') THEN 'content_mismatch' WHEN suffix = '.docx' THEN 'content_mismatch' ELSE 'accepted' END AS admission FROM c""")
def file_admission(spark, sf):
    body = F.concat(F.when(F.col("page_id") % 12 == 0, "%PDF-1.7 ").otherwise(""), "html").cast("binary")
    return fi.file_admission(listing(spark, sf).withColumn("content", body).withColumn("size", F.length("content")), 2000).select("page_id", "admission")


@query("content_fingerprint", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fi.content_fingerprint(F.col("text").cast("binary")).alias("hash"))


# The state knows the labelled documents, toxic ones with another hash, and the pages, which are gone.


def snapshot(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))


def state(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    seen = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    docs = d.select(path.alias("path"), F.sha2(seen, 256).alias("hash"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("hash"))
    return docs.unionByName(pages).withColumn("chunk_ids", F.array(F.concat("path", F.lit("#0")), F.concat("path", F.lit("#1"))))


def new_chunks(spark, sf):
    """Lines of the documents as chunks."""
    rows = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows.select("path", F.concat("path", F.lit("::"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("chunk_id"), "text")


def old_chunks(spark, sf):
    return state(spark, sf).select("path", F.explode("chunk_ids").alias("chunk_id"), F.col("hash").alias("text"))


def failed(spark, sf):
    d = table(spark, sf, "documents").filter("lang = 'es'")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))


DIFF = """snap AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents),
stt AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS hash FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'page/' || page_id, sha256(html) FROM pages),
dif AS (SELECT coalesce(n.path, o.path) AS path, n.hash AS hash, o.hash AS old_hash, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN n.hash = o.hash THEN 'skipped' ELSE 'updated' END AS status FROM snap n FULL JOIN stt o ON n.path = o.path),
fail AS (SELECT 'doc/' || doc_id AS path FROM documents WHERE lang = 'es')"""


def diff(spark, sf):
    return ing.ingest_diff(snapshot(spark, sf), state(spark, sf))


@query("ingest_diff", f"WITH {DIFF} SELECT * FROM dif")
def ingest_diff(spark, sf):
    return diff(spark, sf).select("path", "hash", "old_hash", "status")


_NEW = f"nw AS (SELECT 'doc/' || doc_id AS path, unnest(a) AS text, 'doc/' || doc_id || '::' || lpad(CAST(generate_subscripts(a, 1) - 1 AS VARCHAR), 6, '0') AS chunk_id FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents))"


@query("ingest_apply", f"""WITH {DIFF}, {_NEW}, od AS (SELECT path, path || '#' || unnest([0, 1]) AS chunk_id, hash AS text FROM stt)
SELECT * FROM od WHERE path NOT IN (SELECT path FROM dif WHERE status IN ('updated', 'deleted')) UNION ALL SELECT path, chunk_id, text FROM nw JOIN dif USING (path) WHERE status IN ('new', 'updated') AND path NOT IN (SELECT path FROM fail)""")
def ingest_apply(spark, sf):
    return ing.ingest_chunks(old_chunks(spark, sf), diff(spark, sf), new_chunks(spark, sf), failed(spark, sf)).select("path", "chunk_id", "text")


@query("ingest_state", f"""WITH {DIFF}, {_NEW}, dn AS (SELECT path, hash, (SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM nw WHERE nw.path = dif.path) AS chunk_ids FROM dif WHERE status IN ('new', 'updated') AND path NOT IN (SELECT path FROM fail))
SELECT path, hash, path || '#0,' || path || '#1' AS chunk_ids FROM stt WHERE path NOT IN (SELECT path FROM dn) AND path NOT IN (SELECT path FROM dif WHERE status = 'deleted') UNION ALL SELECT * FROM dn WHERE chunk_ids IS NOT NULL""")
def ingest_state(spark, sf):
    out = ing.ingest_state(state(spark, sf), diff(spark, sf), new_chunks(spark, sf), failed(spark, sf))
    return out.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("ingest_report", f"WITH {DIFF} SELECT CASE WHEN path IN (SELECT path FROM fail) THEN 'failed' ELSE status END AS status, count(*) AS n FROM dif GROUP BY 1")
def ingest_report(spark, sf):
    return ing.ingest_report(diff(spark, sf), failed(spark, sf))


@query("failed_paths", "SELECT 'doc/' || doc_id AS path FROM documents WHERE lang = 'es' ORDER BY 1 LIMIT 20")
def failed_paths(spark, sf):
    return ing.failed_paths(failed(spark, sf))


@query("read_eval_json", "SELECT CAST(item_id AS INTEGER) AS id, 'A' AS category, text AS question FROM benchmark")
def read_eval_json(spark, sf):
    path = fresh_path(spark, "questions-json")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("A").alias("category"), F.col("text").alias("question"))
    re_.write_eval_json(rows, path)
    return re_.read_eval_json(spark, path, "questions", multiline=False).select("id", "category", "question")


# A question list per source: every document is a header line and its lines as questions.


def question_lines(spark, sf):
    d = table(spark, sf, "documents")
    head = F.concat(F.chr(F.col("doc_id") % 16 + 65), F.lit(".  "), "lang", F.lit(" ("), F.col("doc_id").cast("string"), F.lit("~"), (F.col("doc_id") + 40).cast("string"), F.lit(") "))
    body = F.split("text", "\n")
    ls = F.when(F.col("lang") == "fr", body).otherwise(F.concat(F.array(head), body))
    rows = d.select(F.col("source").alias("list_id"), "doc_id", F.posexplode(ls).alias("n", "line"))
    return rows.select("list_id", (F.col("doc_id") * 1000000 + F.col("n")).alias("pos"), "line")


QLIST = f"""ql0 AS (SELECT source AS list_id, doc_id, CASE WHEN lang = 'fr' THEN string_split(text, {NL}) ELSE list_concat([chr(CAST(doc_id % 16 + 65 AS INTEGER)) || '.  ' || lang || ' (' || doc_id || '~' || (doc_id + 40) || ') '], string_split(text, {NL})) END AS a FROM documents),
ql1 AS (SELECT list_id, doc_id * 1000000 + generate_subscripts(a, 1) AS pos, unnest(a) AS raw FROM ql0),
ql2 AS (SELECT list_id, pos, {strip_sql('raw')} AS line FROM ql1 WHERE {strip_sql('raw')} <> ''),
ql3 AS (SELECT *, regexp_matches(line, {quoted(re_.QUESTION_HEADER)}) AS is_head FROM ql2),
ql4 AS (SELECT *, last_value(CASE WHEN is_head THEN line END IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY pos) AS head FROM ql3),
qs AS (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY pos) AS id, line AS question, {', '.join(f"regexp_extract(head, {quoted(re_.QUESTION_HEADER)}, {n}) AS h{n}" for n in range(1, 5))} FROM ql4 WHERE NOT is_head AND head IS NOT NULL)"""


def parsed_questions(spark, sf):
    return re_.parse_question_list(question_lines(spark, sf), position_bucket("pos", 64 * 1000000))


@query("parse_question_list", f"WITH {QLIST} SELECT list_id, id, h1 AS category, h2 AS category_name, CAST(h3 AS INTEGER) AS range_first, CAST(h4 AS INTEGER) AS range_last, question FROM qs")
def parse_question_list(spark, sf):
    return parsed_questions(spark, sf)


@query("question_violations", f"""WITH {QLIST}, v AS (SELECT list_id, count(*) AS questions, (SELECT string_agg(c, '' ORDER BY c) FROM (SELECT DISTINCT h1 AS c FROM qs q WHERE q.list_id = qs.list_id)) AS categories, count(*) FILTER (id NOT BETWEEN CAST(h3 AS INTEGER) AND CAST(h4 AS INTEGER)) AS out_of_range FROM qs GROUP BY list_id)
SELECT *, questions <> 250 AS wrong_count, categories <> 'ABCDEFGHIJKLMNOP' AS wrong_categories FROM v""")
def question_violations(spark, sf):
    return re_.question_violations(parsed_questions(spark, sf))


@query("source_manifest", "SELECT 'Report_' || lang || '_' || source || '_' || doc_id AS doc_id, 'Report [' || lang || '] ' || source || ' ' || doc_id || '.TXT' AS original_name, '/in/' || 'Report [' || lang || '] ' || source || ' ' || doc_id || '.TXT' AS source_path, '.txt' AS format, CAST(length(text) AS INTEGER) AS char_count FROM documents")
def source_manifest(spark, sf):
    path = F.concat(F.lit("/in/Report ["), "lang", F.lit("] "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return re_.source_manifest(table(spark, sf, "documents").select(path.alias("path"), "text"))


# Every benchmark item as a category that names three documents, one of them unknown for some.
@query("explode_source_map", f"""WITH m AS (SELECT item_id AS category, [item_id * 3, 999999000 + item_id, item_id + 1] AS s FROM benchmark), e AS (SELECT category, unnest(s) AS doc_id, generate_subscripts(s, 1) - 1 AS place FROM m)
SELECT category, CAST(place AS INTEGER) AS place, doc_id, '=== [출처: ' || doc_id || '] ===' || {NL} || text AS block FROM e JOIN documents USING (doc_id)""")
def explode_source_map(spark, sf):
    n = F.col("item_id")
    m = table(spark, sf, "benchmark").select(n.alias("category"), F.array(n * 3, n + 999999000, n + 1).alias("sources"))
    return re_.explode_source_map(m, table(spark, sf, "documents").select("doc_id", "text")).select("category", "place", "doc_id", "block")


def decisions(spark, sf):
    e = table(spark, sf, "events")
    debug = F.to_json(F.struct(F.lit("semantic").alias("mode"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("decision"), F.round(F.col("value") / 500, 4).cast("string").alias("top1_score")))
    return e.select(
        F.col("event_id").alias("log_id"), "ts", F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string")).otherwise("").alias("user_id"),
        F.repeat("props", 200).alias("input_text"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("final_task"), debug.alias("routing_debug"))


@query("append_routing_log", """SELECT event_id AS log_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CASE WHEN user_id % 5 > 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS user_id, left(repeat(props, 200), 2000) AS input_text,
  CASE WHEN event_type <> 'click' THEN event_type ELSE 'unknown' END AS final_task, 'semantic' AS mode, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS semantic_decision, round(value / 500, 4) AS top1, '' AS margin FROM events""")
def append_routing_log(spark, sf):
    path = fresh_path(spark, "routing-log")
    re_.append_routing_log(decisions(spark, sf), path)
    out = spark.read.parquet(path).drop("routing_debug")
    return out.withColumn("top1", F.col("top1_score").cast("double")).drop("top1_score")


def _run(spark, sf):
    """A scored run of the labelled documents: what was answered, how it was judged."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    right = F.col("quality") == 1
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.when(F.col("lang") != "fr", F.col("lang")).alias("answer_type"),
        F.when(F.col("toxic") == 0, "search").otherwise("").alias("task_type"), right.alias("correct"), F.when(right, 1.0).otherwise(F.round(F.col("n_chars") % 10 / 20.0, 2)).alias("score_value"),
        F.when(F.col("n_chars") % 50 == 0, "timeout").alias("error"), F.lit("llm_judge").alias("method"), (F.col("n_chars") / 100.0).alias("elapsed_sec"), F.col("text").alias("reasoning"))


def _other_run(spark, sf):
    return _run(spark, sf).withColumn("correct", F.col("correct") != (F.col("id") % 7 == 0))


RUN = """run AS (SELECT doc_id AS id, source AS category, CASE WHEN lang <> 'fr' THEN lang END AS answer_type, CASE WHEN toxic = 0 THEN 'search' ELSE '' END AS task_type, quality = 1 AS correct,
  CASE WHEN quality = 1 THEN 1e0 ELSE round(n_chars % 10 / 20e0, 2) END AS score_value, CASE WHEN n_chars % 50 = 0 THEN 'timeout' END AS error, 'llm_judge' AS method, n_chars / 100e0 AS elapsed_sec, text AS reasoning FROM documents JOIN labels USING (doc_id)),
orun AS (SELECT * REPLACE (correct <> (id % 7 = 0) AS correct) FROM run)"""
BREAK = f"""bd AS (SELECT 'category' AS dimension, category AS value, round(avg(score_value), 6) AS mean_score, count(*) AS n FROM run GROUP BY 2 UNION ALL SELECT 'answer_type', coalesce(answer_type, 'reasoning'), round(avg(score_value), 6), count(*) FROM run GROUP BY 2
  UNION ALL SELECT 'task_type', CASE WHEN task_type <> '' THEN task_type ELSE 'unknown' END, round(avg(score_value), 6), count(*) FROM run GROUP BY 2)"""


@query("write_report", f"""WITH {RUN}, {BREAK} SELECT 0 AS place, '' AS key, '| dimension | value | n |' AS line UNION ALL SELECT 1, '', '| --- | --- | --- |' UNION ALL SELECT 2, dimension || ':' || value, '| ' || dimension || ' | ' || value || ' | ' || n || ' |' FROM bd""")
def write_report(spark, sf):
    b = ev.breakdown(_run(spark, sf)).withColumn("key", F.concat_ws(":", "dimension", "value"))
    return ev.markdown_lines(b, ["dimension", "value", "n"], "key")


def _told(run):
    return run.withColumns({"question": F.col("reasoning"), "ground_truth": F.col("category"), "answer": F.col("reasoning")})


def _one_sql(x):
    return f"translate({x}, chr(13) || chr(10), '  ')"


_TABLE_SQL = " UNION ALL ".join(
    f"SELECT unnest(['{heading}', '| {label} | N | Avg Score |', '| --- | --- | --- |', '']) AS line UNION ALL SELECT '| ' || value || ' | ' || n || ' | ' || printf('%.1f', mean_score * 100) || '% |' FROM bd WHERE dimension = '{d}'"
    for d, heading, label in rp.TABLES)


@query("evaluation_report", f"""WITH {RUN}, {BREAK}, o AS (SELECT count(*) AS t, count(*) FILTER (correct) AS c, round(avg(score_value), 6) AS m, count(*) FILTER (coalesce(error, '') <> '') AS e FROM run),
w AS (SELECT * FROM run WHERE NOT correct ORDER BY score_value, id LIMIT 20)
SELECT unnest(['# Eval Report — `run`', '', '- 총 문항: **' || t || '**', '- 정답 (binary): **' || c || '/' || t || ' = ' || printf('%.1f', c / CAST(t AS DOUBLE) * 100) || '%**', '- 평균 점수 (partial): **' || printf('%.3f', m) || '**', '- 시스템 오류: ' || e, '']) AS line FROM o
UNION ALL {_TABLE_SQL} UNION ALL SELECT '## 상위 실패 사례 (' || count(*) || '건)' FROM w
UNION ALL SELECT unnest(['### Q' || id || ' [' || category || ']', '- **질문**: ' || {_one_sql('reasoning')}, '- **정답**: ' || category, '- **시스템 답변**: ' || left({_one_sql('reasoning')}, 300), '- **task_type**: `' || task_type || '`', '- **judge**: score=' || printf('%.2f', score_value) || ', method=' || method, '  - reasoning: ' || {_one_sql('reasoning')}, '']) FROM w""")
def evaluation_report(spark, sf):
    """The report as it is read back from its text file."""
    path = fresh_path(spark, "report")
    rp.write_lines(rp.report_lines(_told(_run(spark, sf)), "run"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("comparison_report", f"""WITH {RUN}, b AS (SELECT r.*, o.correct AS now FROM run r JOIN orun o USING (id)), s AS (SELECT count(*) AS t, count(*) FILTER (correct) AS x, count(*) FILTER (now) AS y, count(*) FILTER (now AND NOT correct) AS i, count(*) FILTER (correct AND NOT now) AS d FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY id) AS r FROM b WHERE correct <> now)
SELECT unnest(['# Compare — `run` vs `other`', '', '- 공통 문항: ' || t, '- run: ' || x || '/' || t || ' = ' || printf('%.1f', x / CAST(t AS DOUBLE) * 100) || '%', '- other: ' || y || '/' || t || ' = ' || printf('%.1f', y / CAST(t AS DOUBLE) * 100) || '%', '- **변화: ' || printf('%+d', y - x) || '**', '', '## 신규 정답 (개선 ' || i || '건)', '## 신규 오답 (회귀 ' || d || '건)']) AS line FROM s
UNION ALL SELECT '- Q' || id || ' [' || category || ']: ' || left({_one_sql('reasoning')}, 80) FROM k WHERE r <= 20""")
def comparison_report(spark, sf):
    path = fresh_path(spark, "comparison")
    rp.write_lines(rp.comparison_lines(_told(_run(spark, sf)), _told(_other_run(spark, sf)), "run", "other"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def entries(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.concat(F.lit(" qa_"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("question"), F.when(F.col("quality") == 1, F.col("text")).otherwise("  ").alias("answer"),
        F.col("source").alias("doc_id"), F.col("text").alias("snippet"), F.lit(None).cast("string").alias("location"), F.when(F.col("lang") == "en", "numerical").alias("answer_type"))


def cached(spark, sf):
    d = table(spark, sf, "documents")
    blank = F.lit("")
    return d.select(F.concat(F.lit("qa_"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("question"), F.col("source").alias("answer"), blank.alias("doc_id"), blank.alias("snippet"), blank.alias("location"), F.lit("old").alias("answer_type"))


@query("upsert_by_id", f"""WITH n AS (SELECT 'qa_' || doc_id AS id, {strip_sql('text')} AS question, CASE WHEN quality = 1 THEN {strip_sql('text')} ELSE '' END AS answer, source AS doc_id, left(text, 500) AS snippet, '' AS location, CASE WHEN lang = 'en' THEN 'numerical' ELSE 'reasoning' END AS answer_type FROM documents JOIN labels USING (doc_id)),
v AS (SELECT * FROM n WHERE question <> '' AND answer <> '') SELECT * FROM v UNION ALL SELECT 'qa_' || doc_id, lang, source, '', '', '', 'old' FROM documents WHERE 'qa_' || doc_id NOT IN (SELECT id FROM v)""")
def upsert_by_id(spark, sf):
    return ing.upsert_by_id(cached(spark, sf), entries(spark, sf))


@query("upsert_counts", f"""WITH n AS (SELECT 'qa_' || doc_id AS id, quality = 1 AND {strip_sql('text')} <> '' AS good FROM documents JOIN labels USING (doc_id)), w AS (SELECT count(DISTINCT id) FILTER (good) AS w, count(*) AS g FROM n), r AS (SELECT count(DISTINCT id) AS r FROM n WHERE good AND id IN (SELECT 'qa_' || doc_id FROM documents WHERE lang <> 'de'))
SELECT g AS given, w AS written, r AS replaced, w - r AS added, g - w AS left_out FROM w, r""")
def upsert_counts(spark, sf):
    """Against a table that lacks the entries of German documents."""
    return ing.upsert_counts(cached(spark, sf).where("question <> 'de'"), entries(spark, sf))


def samples(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    text = F.left(tx.strip(F.col("text")), F.lit(500))
    return d.groupBy(F.col("lang").alias("task"), text.alias("text")).agg(F.when(F.max("quality") == 1, "seed").otherwise("admin").alias("source"), F.min("doc_id").alias("created_at"))


SAMPLES = f"smp AS (SELECT lang AS task, left({strip_sql('text')}, 500) AS text, CASE WHEN max(quality) = 1 THEN 'seed' ELSE 'admin' END AS source, min(doc_id) AS created_at FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"


@query("insert_if_absent", f"""WITH {SAMPLES}, n AS (SELECT lang AS task, left({strip_sql('text')}, 500) AS text, min({{'c': doc_id, 's': source}}) AS f FROM documents GROUP BY 1, 2)
SELECT * FROM smp UNION ALL SELECT task, text, f.s, f.c FROM n WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM smp WHERE smp.task = n.task AND smp.text = n.text)""")
def insert_if_absent(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("task"), "text", "source", F.col("doc_id").alias("created_at"))
    return ing.insert_if_absent(samples(spark, sf), rows)


@query("reset_by_source", f"""WITH {SAMPLES}, k AS (SELECT task, text, source, created_at FROM smp WHERE source <> 'seed'), sd AS (SELECT lang AS task, {strip_sql('text')} AS text, max(doc_id) AS created_at FROM documents GROUP BY 1, 2)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM sd WHERE k.task = sd.task AND k.text = sd.text) UNION ALL SELECT task, text, 'seed', created_at FROM sd""")
def reset_by_source(spark, sf):
    seeds = table(spark, sf, "documents").select(F.col("lang").alias("task"), tx.strip(F.col("text")).alias("text"), F.col("doc_id").alias("created_at"))
    return ing.reset_by_source(samples(spark, sf), seeds)


# ---------------------------------------------------------------- selection


def eval_questions(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("question"))


@query("select_eval_subset", "SELECT doc_id AS id, lang AS category, text AS question FROM documents WHERE lang IN ('de', 'fr') ORDER BY doc_id LIMIT 50")
def select_eval_subset(spark, sf):
    return ing.select_eval_subset(eval_questions(spark, sf), categories=["de", "fr"], limit=50)


@query("select_eval_by_ids", "SELECT doc_id AS id, lang AS category, text AS question FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def select_eval_by_ids(spark, sf):
    return ing.select_eval_subset(eval_questions(spark, sf), ids=table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("resume_filter", "SELECT doc_id AS id, lang AS category, text AS question FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_filter(spark, sf):
    return ing.resume(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), eval_questions(spark, sf)).select("id", "category", "question")


def eval_labels(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    conf = F.when(F.col("lang") == "es", "n/a").when(F.col("lang") == "fr", F.lit(None)).otherwise((F.col("n_chars") % 100 / 100).cast("string"))
    return d.select(F.col("doc_id").alias("id"), conf.alias("confidence"), (F.col("toxic") == 1).alias("needs_review"), F.when(F.col("quality").isNull(), "ERROR").when(F.col("quality") == 0, "UNKNOWN").otherwise(F.col("lang")).alias("answer"))


LABELS = """lb AS (SELECT doc_id AS id, CASE WHEN lang = 'es' THEN 'n/a' WHEN lang <> 'fr' THEN CAST(n_chars % 100 / 100e0 AS VARCHAR) END AS confidence, toxic = 1 AS needs_review, CASE WHEN quality IS NULL THEN 'ERROR' WHEN quality = 0 THEN 'UNKNOWN' ELSE lang END AS answer FROM documents LEFT JOIN labels USING (doc_id))"""


@query("trusted_labels", f"WITH {LABELS} SELECT id, CASE WHEN coalesce(needs_review, false) THEN 'needs_review' WHEN coalesce(try_cast(confidence AS DOUBLE), 1e0) < 7e-1 THEN 'low_confidence' ELSE 'trusted' END AS trust FROM lb")
def trusted_labels(spark, sf):
    return ing.trust(eval_labels(spark, sf)).select("id", "trust")


@query("label_quality", f"WITH {LABELS} SELECT count(*) AS labels, count(*) FILTER (coalesce(needs_review, coalesce(try_cast(confidence AS DOUBLE), 0) < 7e-1)) AS to_review, count(*) FILTER (answer = 'ERROR') AS failed, count(*) FILTER (answer = 'UNKNOWN') AS unknown FROM lb")
def label_quality(spark, sf):
    return ev.label_quality(eval_labels(spark, sf).withColumn("confidence", F.col("confidence").try_cast("double")))


# ---------------------------------------------------------------- conversations and state


def messages(spark, sf):
    return table(spark, sf, "conversations")


# Roles by text length, so that user turns also follow each other.
def loose_messages(spark, sf):
    return messages(spark, sf).withColumn("role", F.when(F.length("text") % 3 > 0, "user").otherwise("assistant"))


LOOSE = "lm AS (SELECT * REPLACE (CASE WHEN length(text) % 3 > 0 THEN 'user' ELSE 'assistant' END AS role) FROM conversations)"


@query("turn_pairs", f"""WITH {LOOSE}, a AS (SELECT *, row_number() OVER w AS n, lead(turn) OVER w AS reply_turn, lead(role) OVER w AS reply_role, lead(text) OVER w AS reply_text FROM lm WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, n - coalesce(max(CASE WHEN role <> 'user' THEN n END) OVER (PARTITION BY conv_id ORDER BY turn), 0) - 1 AS k FROM a) SELECT conv_id, turn, text, reply_turn, reply_role, reply_text FROM b WHERE role = 'user' AND k % 2 = 0 AND reply_turn IS NOT NULL""")
def turn_pairs(spark, sf):
    return tu.turn_pairs(loose_messages(spark, sf))


@query("last_exchange", f"""WITH {LOOSE}, s AS (SELECT * FROM lm WHERE text <> ''), a AS (SELECT conv_id, max(turn) AS reply_turn FROM s WHERE role = 'assistant' GROUP BY 1), u AS (SELECT conv_id, reply_turn, max(turn) AS user_turn FROM s JOIN a USING (conv_id) WHERE role = 'user' AND turn < reply_turn GROUP BY 1, 2)
SELECT u.conv_id, user_turn, x.text AS user_text, reply_turn, y.text AS reply_text FROM u JOIN s x ON x.conv_id = u.conv_id AND x.turn = user_turn JOIN s y ON y.conv_id = u.conv_id AND y.turn = reply_turn""")
def last_exchange(spark, sf):
    return tu.last_exchange(loose_messages(spark, sf)).select("conv_id", "user_turn", "user_text", "reply_turn", "reply_text")


@query("window_text", f"WITH {LOOSE}, u AS (SELECT * FROM lm WHERE role = 'user') SELECT conv_id, turn, text, CAST(count(*) OVER w - 1 AS INTEGER) AS recent, array_to_string(list(text) OVER w, ' ') AS \"window\" FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def window_text(spark, sf):
    return tu.window_text(loose_messages(spark, sf))


@query("recent_history", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, {strip_sql('text')} AS t FROM conversations)
SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN '사용자' ELSE '어시스턴트' END || ': ' || left(t, 300), {NL} ORDER BY turn) FILTER (t <> ''), '') AS history FROM l WHERE r <= 4 GROUP BY 1""")
def recent_history(spark, sf):
    return tu.recent_history(messages(spark, sf))


@query("trim_messages", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def trim_messages(spark, sf):
    return tu.trim_messages(messages(spark, sf), 4)


@query("latest_per_thread", "SELECT key, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, CASE WHEN event_type = 'click' THEN user_id || '::sub' ELSE CAST(user_id AS VARCHAR) END AS key FROM events)) WHERE r = 1")
def latest_per_thread(spark, sf):
    key = tu.storage_key(F.col("user_id"), F.when(F.col("event_type") == "click", "sub"))
    rows = table(spark, sf, "events").select(key.alias("key"), "ts", "event_id", "event_type", "value")
    return tu.latest_per_thread(rows, "key", ["ts", "event_id"]).drop("ts")


@query("expire_ttl", "SELECT event_id, CAST(floor(epoch(ts + INTERVAL 7 DAY)) AS BIGINT) AS expires FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31 00:00:00'")
def expire_ttl(spark, sf):
    out = tu.expire_ttl(table(spark, sf, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return out.select("event_id", F.unix_timestamp("expires_at").alias("expires"))


# Trace steps of a user; an error resets the trace.
def steps(spark, sf):
    e = table(spark, sf, "events")
    items = F.when(F.col("event_type") != "error", F.array("event_type", F.concat(F.lit("v"), F.col("event_id").cast("string"))))
    return e.select("user_id", "ts", "event_id", items.alias("items"), "event_type", F.round(F.col("value") / 100).cast("long").alias("level"))



@query("reset_or_append", """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS m FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM s WHERE g = m AND event_type <> 'error'), x AS (SELECT user_id, i * 2 AS place, event_type AS item FROM k UNION ALL SELECT user_id, i * 2 + 1, 'v' || event_id FROM k) SELECT * FROM x""")
def reset_or_append(spark, sf):
    return tu.reset_or_append(steps(spark, sf), "user_id", "ts", F.date_trunc("hour", "ts"))


@query("changed_fields", """WITH o AS (SELECT user_id, event_id, event_type, CAST(round(value / 100) AS BIGINT) AS level, CAST(event_id % 4 AS INTEGER) AS n, row_number() OVER w AS k, lag(event_type) OVER w AS pe, lag(CAST(round(value / 100) AS BIGINT)) OVER w AS pl, lag(CAST(event_id % 4 AS INTEGER)) OVER w AS pn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, concat_ws(',', CASE WHEN k = 1 OR event_type <> pe THEN 'event_type' END, CASE WHEN k = 1 OR level <> pl THEN 'level' END) AS changed, CASE WHEN k = 1 THEN n ELSE greatest(n - pn, 0) END AS new_steps FROM o""")
def changed_fields(spark, sf):
    e = table(spark, sf, "events")
    trace = F.array_repeat(F.lit("step"), (F.col("event_id") % 4).cast("int"))
    s = e.select("user_id", F.struct("ts", "event_id").alias("at"), "ts", "event_type", F.round(F.col("value") / 100).cast("long").alias("level"), trace.alias("trace"))
    out = tu.changed_fields(s, "user_id", "at", F.date_trunc("hour", "ts"), ["event_type", "level"], "trace")
    return out.select(F.col("at.event_id").alias("event_id"), F.array_join("changed", ",").alias("changed"), F.size("trace_delta").alias("new_steps"))


@query("recent_by_user", "SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_by_user(spark, sf):
    return tu.recent_by_user(table(spark, sf, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "rank")


# ---------------------------------------------------------------- streams and their batch twins


def stream(spark, sf, name):
    """A table as it arrives, be it one file or a folder of files; a stream reads folders only."""
    path, schema = source(sf, name), table(spark, sf, name).schema
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    local = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in local})


@query("routing_counts", "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, event_type AS route, count(*) AS n FROM events GROUP BY 1, 2")
def routing_counts(spark, sf):
    out = jobs.routing_counts(table(spark, sf, "events"), "ts", "event_type")
    return out.select(F.unix_timestamp("window_start").alias("minute"), "route", "n")


@query("stream_routing_log", """SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, event_type AS route, count(*) AS n FROM events GROUP BY 1, 2
HAVING minute + 60 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def stream_routing_log(spark, sf):
    """Windows that the watermark has closed, as the stream appends them."""
    path = fresh_path(spark, "route-counts")
    counts = jobs.routing_counts(jobs.watermarked(stream(spark, sf, "events"), "ts"), "ts", "event_type")
    jobs.append_to(counts, path, path + "-checkpoint").awaitTermination()
    return spark.read.parquet(path).select(F.unix_timestamp("window_start").alias("minute"), "route", "n")


@query("rate_limit", "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS attempts FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, sf):
    out = jobs.rate_limit(table(spark, sf, "events"), "user_id", "ts", 1, "1 hour")
    return out.select("user_id", F.unix_timestamp("window_start").alias("hour"), "attempts")


@query("stream_ingest", f"SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS chunk_no, unnest(a) AS text FROM (SELECT doc_id, text, string_split(text, {NL}) AS a FROM documents)")
def stream_ingest(spark, sf):
    path = fresh_path(spark, "ingest-log")
    arriving = stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit(0).alias("modified"))

    def lines(rows):
        return rows.select("path", "hash", F.posexplode(F.split("content", "\n")).alias("chunk_no", "text"))

    jobs.stream_ingest(arriving, path, path + "-checkpoint", lines).awaitTermination()
    return jobs.current_chunks(spark, path).select("path", "hash", "chunk_no", "text")


@query("stream_thread_state", "SELECT CAST(conv_id AS VARCHAR) AS thread, count(*) AS messages, least(count(*), 4) AS kept, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1")
def stream_thread_state(spark, sf):
    """Newest state per thread, as the stream reports it batch by batch."""
    path = fresh_path(spark, "thread-state")
    rows = stream(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("thread"), "turn", "text")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    states = jobs.stream_thread_state(rows, 4).writeStream.foreachBatch(write).outputMode("update")
    jobs.run_available(states.option("checkpointLocation", path + "-checkpoint"), spark)
    return tu.latest_per_thread(spark.read.option("basePath", path).parquet(path), "thread", ["batch"]).drop("batch")


# ---------------------------------------------------------------- evaluation


@query("normalize_answer", f"SELECT conv_id, turn, regexp_replace(lower({strip_sql(f'''regexp_replace(text, {quoted(tx.WS + '+')}, ' ', 'g')''')}), {quoted(ev.PUNCTUATION)}, '', 'g') AS text FROM conversations")
def normalize_answer(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", ev.normalize_answer(F.col("text")).alias("text"))


def _norm(x):
    return f"regexp_replace(lower({strip_sql(f'''regexp_replace({x}, {quoted(tx.WS + '+')}, ' ', 'g')''')}), {quoted(ev.PUNCTUATION)}, '', 'g')"


# A document as the answer; the gold is a piece of it in upper case, of another text, or missing.
def gold_labels(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    gold = F.when(F.col("quality") == 0, F.lit("UNKNOWN")).when(F.col("lang") == "de", F.reverse(F.substring("text", 5, 30))).otherwise(F.upper(F.substring("text", 5, 30)))
    alts = F.when(F.col("source").isin("src1", "src2", "src3"), F.array(F.lit(""), F.substring("text", 40, 20)))
    kind = F.when(F.col("lang") == "en", "exact_phrase").when(F.col("lang") == "de", "numerical").when(F.col("lang") == "fr", "reasoning")
    return d.select(F.col("doc_id").alias("id"), gold.alias("gold"), alts.alias("alternatives"), kind.alias("answer_type"))


def results(spark, sf):
    d = table(spark, sf, "documents")
    judged = F.when(F.col("n_chars") % 5 > 0, F.col("n_chars") % 2 == 0)
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.when(F.col("n_chars") % 20 == 0, "boom").alias("error"), judged.alias("judge_correct"),
        F.when(judged.isNotNull(), F.col("n_chars") % 10 / 10.0).alias("judge_score"), (F.col("n_chars") / 100.0).alias("elapsed_sec"),
        F.concat(F.lit("judged "), F.col("doc_id").cast("string")).alias("judge_reasoning"), F.array(F.concat(F.lit("m"), F.col("doc_id").cast("string"))).alias("judge_missing"))


SCORED = f"""gl AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'UNKNOWN' WHEN lang = 'de' THEN reverse(substr(text, 5, 30)) ELSE upper(substr(text, 5, 30)) END AS gold,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN ['', substr(text, 40, 20)] ELSE [] END AS alts, CASE lang WHEN 'en' THEN 'exact_phrase' WHEN 'de' THEN 'numerical' WHEN 'fr' THEN 'reasoning' END AS answer_type FROM documents JOIN labels USING (doc_id)),
rs AS (SELECT doc_id AS id, text AS answer, CASE WHEN n_chars % 20 = 0 THEN 'boom' END AS error, CASE WHEN n_chars % 5 > 0 THEN n_chars % 2 = 0 END AS jc, CASE WHEN n_chars % 5 > 0 THEN n_chars % 10 / 10e0 END AS js, n_chars / 100e0 AS elapsed_sec FROM documents),
mt AS (SELECT rs.*, gl.gold, gl.answer_type, gl.id IS NOT NULL AS known, len(list_filter(list_concat([gold], alts), lambda c: {_norm('c')} <> '' AND contains({_norm('answer')}, {_norm('c')}))) > 0 AS hit FROM rs LEFT JOIN gl USING (id)),
md AS (SELECT *, CASE WHEN NOT known THEN 'no_label' WHEN error IS NOT NULL THEN 'system_error' WHEN gold IN ('UNKNOWN', 'ERROR', '') THEN 'skip_no_label' WHEN answer_type IN ('numerical', 'fill_blank', 'exact_phrase') AND hit THEN 'exact' WHEN jc IS NULL THEN 'judge_error' ELSE 'llm_judge' END AS method FROM mt),
sc AS (SELECT *, method = 'exact' OR (method = 'llm_judge' AND jc) AS correct, CASE method WHEN 'exact' THEN 1e0 WHEN 'llm_judge' THEN js ELSE 0e0 END AS score_value FROM md)"""


@query("exact_or_alt", f"WITH {SCORED} SELECT id, hit FROM mt WHERE known")
def exact_or_alt(spark, sf):
    both = results(spark, sf).join(gold_labels(spark, sf), "id")
    return both.select("id", ev.exact_or_alt(F.col("answer"), F.col("gold"), F.col("alternatives")).alias("hit"))


def scored(spark, sf):
    return ev.score_answers(results(spark, sf), gold_labels(spark, sf))


@query("score_answers", f"""WITH {SCORED} SELECT id, method, coalesce(correct, false) AS correct, score_value, CASE WHEN known THEN gold END AS ground_truth,
  CASE method WHEN 'system_error' THEN '시스템 오류: boom' WHEN 'skip_no_label' THEN '라벨이 UNKNOWN/ERROR로 채점 불가' WHEN 'exact' THEN 'exact match (or alternative)' WHEN 'llm_judge' THEN 'judged ' || id ELSE '' END AS reasoning,
  CASE WHEN method = 'llm_judge' THEN 'm' || id ELSE '' END AS missing, '' AS extra FROM sc""")
def score_answers(spark, sf):
    shown = [F.array_join(c, "|").alias(c) for c in ("missing", "extra")]
    return scored(spark, sf).select("id", "method", "correct", "score_value", "ground_truth", "reasoning", *shown)


@query("accuracy_summary", f"WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (correct) AS correct, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(score_value), 6) AS mean_score, count(*) FILTER (error IS NOT NULL OR method = 'system_error') AS errors, round(avg(elapsed_sec), 6) AS mean_elapsed FROM sc")
def accuracy_summary(spark, sf):
    return ev.accuracy_summary(scored(spark, sf))


@query("breakdown", f"WITH {RUN}, {BREAK} SELECT * FROM bd")
def breakdown(spark, sf):
    return ev.breakdown(_run(spark, sf))


@query("top_failures", f"WITH {RUN} SELECT id, category, score_value FROM run WHERE NOT correct ORDER BY score_value, id LIMIT 20")
def top_failures(spark, sf):
    return ev.top_failures(_run(spark, sf)).select("id", "category", "score_value")


COMPARE = f"""{RUN}, cp AS (SELECT r.id, r.correct AS base_correct, o.correct AS other_correct, CASE WHEN NOT r.correct AND o.correct THEN 'improved' WHEN r.correct AND NOT o.correct THEN 'regressed' ELSE 'same' END AS change FROM run r JOIN orun o USING (id))"""


@query("compare_runs", f"WITH {COMPARE} SELECT * FROM cp")
def compare_runs(spark, sf):
    return ev.compare_runs(_run(spark, sf), _other_run(spark, sf))


@query("compare_summary", f"WITH {COMPARE} SELECT count(*) AS common, count(*) FILTER (base_correct) AS base_correct, count(*) FILTER (other_correct) AS other_correct, count(*) FILTER (change = 'improved') AS improved, count(*) FILTER (change = 'regressed') AS regressed, count(*) FILTER (other_correct) - count(*) FILTER (base_correct) AS delta FROM cp")
def compare_summary(spark, sf):
    return ev.compare_summary(ev.compare_runs(_run(spark, sf), _other_run(spark, sf)))


def overridden(spark, sf):
    fixes = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("checked by hand").alias("reason"))
    unknown = table(spark, sf, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("id"))
    return ev.apply_overrides(_run(spark, sf), fixes, unknown)


OVER = f"""{RUN}, ov AS (SELECT run.* EXCLUDE (correct, score_value, reasoning), toxic = 1 AND NOT correct AS relabeled, lang = 'es' AS ungraded, correct OR toxic = 1 AS correct, CASE WHEN toxic = 1 AND NOT correct THEN 1e0 ELSE score_value END AS score_value,
  CASE WHEN toxic = 1 AND NOT correct THEN '[RELABELED] checked by hand' ELSE reasoning END AS reasoning, CASE WHEN toxic = 1 AND NOT correct THEN reasoning END AS original_reasoning FROM run JOIN documents ON doc_id = id JOIN labels USING (doc_id))"""


@query("apply_overrides", f"""WITH {OVER} SELECT id, correct, score_value, reasoning, original_reasoning, relabeled, ungraded,
  CASE WHEN relabeled THEN 'checked by hand' END AS relabel_reason, CASE WHEN ungraded THEN '라벨 UNKNOWN — 분모 제외' END AS ungraded_reason FROM ov""")
def apply_overrides(spark, sf):
    return overridden(spark, sf).select("id", "correct", "score_value", "reasoning", "original_reasoning", "relabeled", "ungraded", "relabel_reason", "ungraded_reason")


@query("accuracy_excluding", f"""WITH {OVER}, a AS (SELECT (SELECT count(*) FROM run) AS total, (SELECT count(*) FROM run WHERE correct) AS correct_before, count(*) FILTER (relabeled) AS relabeled, count(*) FILTER (ungraded) AS ungraded, count(*) FILTER (NOT ungraded) AS graded, count(*) FILTER (correct AND NOT ungraded) AS correct_after FROM ov)
SELECT *, round(correct_before / CAST(total AS DOUBLE) * 100, 6) AS accuracy_before, round(correct_after / CAST(graded AS DOUBLE) * 100, 6) AS accuracy_after, round(correct_after / CAST(graded AS DOUBLE) * 100 - correct_before / CAST(total AS DOUBLE) * 100, 6) AS gain FROM a""")
def accuracy_excluding(spark, sf):
    return ev.accuracy_excluding(_run(spark, sf), overridden(spark, sf))


@query("fix_labels", """WITH l AS (SELECT doc_id AS id, lang AS answer, source AS answer_type, CASE WHEN quality IS NULL THEN 0e0 ELSE 5e-1 END AS confidence, 'x' AS error, quality = 1 AS fixed FROM documents LEFT JOIN labels USING (doc_id))
SELECT id, CASE WHEN fixed THEN 'fixed ' || id ELSE answer END AS answer, CASE WHEN fixed THEN 'exact_phrase' ELSE answer_type END AS answer_type, CASE WHEN fixed THEN 1e0 ELSE confidence END AS confidence, CASE WHEN NOT coalesce(fixed, false) THEN error END AS error, coalesce(fixed, false) AS fixed FROM l""")
def fix_labels(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    labels = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("answer"), F.col("source").alias("answer_type"), F.when(F.col("quality").isNull(), 0.0).otherwise(0.5).alias("confidence"), F.lit("x").alias("error"))
    fixes = table(spark, sf, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("fixed "), F.col("doc_id").cast("string")).alias("answer"), F.lit("exact_phrase").alias("answer_type"), F.lit(1.0).alias("confidence"))
    return ev.fix_labels(labels, fixes)


# Traces of grading steps written from the events' values.
def traces(spark, sf):
    s = F.col("value") / 500
    n = F.col("event_id")
    cov = F.when(s < 0.3, "none").when(n % 3 == 0, "full").otherwise("partial")
    m = tx.two_digits(s)
    good = F.concat(F.lit("grade:pass("), (n % 9).cast("string"), F.lit("rel/"), (n % 9).cast("string"), F.lit("kept/20total,max="), m, F.lit(",cov="), cov, F.lit(")"))
    bad = F.concat(F.lit("grade:all_irrelevant(0rel/20total,max="), m, F.lit(",cov=none)"))
    spent = F.concat(F.lit("grade:exhausted_after_1rewrites(0rel/20total,max="), m, F.lit(",cov=none)"))
    path = F.when(n % 4 == 0, F.array(F.lit("router:x"), good)).when(n % 4 == 1, F.array(bad, F.lit("rewrite:1"), good)).when(n % 4 == 2, F.array(bad, spent)).otherwise(F.array(F.lit("grade:no_docs"), F.lit("end")))
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.array(F.lit("router:y"))).otherwise(path).alias("path"))


@query("parse_grade_log", """WITH e AS (SELECT event_id AS n, event_type, value / 500 AS s, printf('%.2f', value / 500) AS m FROM events), c AS (SELECT *, CASE WHEN s < 3e-1 THEN 'none' WHEN n % 3 = 0 THEN 'full' ELSE 'partial' END AS cov FROM e WHERE event_type <> 'error')
SELECT n AS event_id, CASE n % 4 WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS n_grades,
  CASE n % 4 WHEN 0 THEN 'pass' WHEN 3 THEN 'no_docs' ELSE 'all_irrelevant' END AS first_status, CASE n % 4 WHEN 0 THEN CAST(n % 9 AS INTEGER) ELSE 0 END AS first_rel, CASE n % 4 WHEN 0 THEN CAST(n % 9 AS INTEGER) ELSE 0 END AS first_kept, CASE n % 4 WHEN 3 THEN 0 ELSE 20 END AS first_total, CASE n % 4 WHEN 3 THEN 0e0 ELSE CAST(m AS DOUBLE) END AS first_max, CASE n % 4 WHEN 0 THEN cov ELSE 'none' END AS first_cov,
  CASE n % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'exhausted_after_1rewrites' ELSE 'no_docs' END AS final_status, CASE WHEN n % 4 < 2 THEN CAST(n % 9 AS INTEGER) ELSE 0 END AS final_rel, CASE WHEN n % 4 < 2 THEN CAST(n % 9 AS INTEGER) ELSE 0 END AS final_kept, CASE n % 4 WHEN 3 THEN 0 ELSE 20 END AS final_total, CASE n % 4 WHEN 3 THEN 0e0 ELSE CAST(m AS DOUBLE) END AS final_max, CASE WHEN n % 4 < 2 THEN cov ELSE 'none' END AS final_cov FROM c""")
def parse_grade_log(spark, sf):
    return ev.parse_grade_log(traces(spark, sf), "event_id", "path")


def scores(spark, sf):
    """The traces above beside scores as text: printed dictionaries, JSON objects and text that holds no score."""
    n = F.col("event_id")
    printed = F.when(n % 3 == 0, "{'correct': False, 'score_value': 0.0}").otherwise("{'score_value': 1.0, 'correct': True}")
    objects = F.when(n % 3 == 0, '{"correct":false,"missing":["x"]}').otherwise('{"correct":true,"missing":[]}')
    runs = table(spark, sf, "events").select(n.alias("id"), F.when(n % 5 < 2, printed).when(n % 5 < 4, objects).otherwise("not scored").alias("score"))
    return ev.graded_runs(ev.parse_grade_log(traces(spark, sf).withColumnRenamed("event_id", "id"), "id", "path"), runs)


SCORES = """ss AS (SELECT event_id AS id, CASE event_id % 4 WHEN 3 THEN 0e0 ELSE CAST(printf('%.2f', value / 500) AS DOUBLE) END AS score, event_id % 3 <> 0 AND event_id % 5 < 4 AS correct,
  CASE WHEN event_id % 4 <> 0 OR value / 500 < 3e-1 THEN 'none' WHEN event_id % 3 = 0 THEN 'full' ELSE 'partial' END AS coverage FROM events WHERE event_type <> 'error')"""


def _d(x):
    return f"CAST({x} AS DOUBLE)"


@query("score_histogram", f"""WITH {SCORES}, b AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_d(a)}, {_d(b)})' for i, (a, b) in enumerate(zip(ev.BINS, ev.BINS[1:])))}) t(bin, low, high))
SELECT bin, low, high, count(id) FILTER (correct) AS correct, count(id) FILTER (NOT correct) AS wrong, round(CASE WHEN count(id) > 0 THEN count(id) FILTER (correct) / CAST(count(id) AS DOUBLE) ELSE 0 END, 6) AS precision FROM b LEFT JOIN ss ON score >= low AND score < high GROUP BY 1, 2, 3""")
def score_histogram(spark, sf):
    return ev.score_histogram(scores(spark, sf))


@query("coverage_accuracy", f"WITH {SCORES}, c AS (SELECT unnest(['full', 'partial', 'none']) AS coverage) SELECT coverage, count(id) AS n, count(id) FILTER (correct) AS correct, round(CASE WHEN count(id) > 0 THEN count(id) FILTER (correct) / CAST(count(id) AS DOUBLE) * 100 ELSE 0 END, 6) AS accuracy FROM c LEFT JOIN ss USING (coverage) GROUP BY 1")
def coverage_accuracy(spark, sf):
    return ev.coverage_accuracy(scores(spark, sf))


@query("threshold_sweep", f"""WITH {SCORES}, t AS (SELECT * FROM (VALUES {', '.join(f'({_d(a)}, {_d(b)})' for a, b in ev.SWEEP)}) t(relevant, partial))
SELECT relevant, partial, count(*) FILTER (score >= relevant) AS passed, round(CASE WHEN count(*) FILTER (score >= relevant) > 0 THEN count(*) FILTER (score >= relevant AND correct) / CAST(count(*) FILTER (score >= relevant) AS DOUBLE) * 100 ELSE 0 END, 6) AS pass_accuracy, count(*) FILTER (score < partial) AS rejected, count(*) FILTER (score < partial AND correct) AS lost FROM t, ss GROUP BY 1, 2""")
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(scores(spark, sf))


@query("weak_passes", f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY score, id) AS k FROM ss WHERE score < 6e-1) SELECT id, round(score, 6) AS score, CASE WHEN correct THEN 'at_risk' ELSE 'suspect' END AS kind FROM r WHERE k <= 20""")
def weak_passes(spark, sf):
    return ev.weak_passes(scores(spark, sf)).select("id", F.round("score", 6).alias("score"), "kind")


@query("ablation_matrix", f"""WITH {SCORES} SELECT id, {', '.join(f"CASE WHEN score >= {_d(r)} THEN 'pass' WHEN score >= {_d(p)} THEN 'partial' ELSE 'drop' END AS {n}" for n, r, p in ev.SETTINGS)} FROM ss""")
def ablation_matrix(spark, sf):
    s = scores(spark, sf)
    graded = F.array(*[F.struct(F.lit(n).alias("setting"), F.when(F.col("score") >= r, "pass").when(F.col("score") >= p, "partial").otherwise("drop").alias("outcome")) for n, r, p in ev.SETTINGS])
    runs = s.select("id", F.inline(graded))
    return ev.ablation_matrix(runs, [n for n, _, _ in ev.SETTINGS], "outcome")


# Gold: the documents that hold the question word for word. Texts are read in their row, only ids go on.
def gold(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    found = re_.holders(questions(spark, sf), docs)
    return found.join(facts(spark, sf).select("item_id", "text_key"), "item_id").select("query_id", "item_id", "text_key")


GOLD = "gd AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, sha256(d.text) AS text_key FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def kinds(spark, sf):
    return questions(spark, sf).select("query_id", F.when(F.length("text") > 250, "long").otherwise("short").alias("kind"))


@query("gold_chunks", f"WITH {GOLD} SELECT query_id, item_id FROM gd")
def gold_chunks(spark, sf):
    return gold(spark, sf).select("query_id", "item_id")


@query("recall_mrr", f"""WITH {HITS_SQL}, {GOLD}, g1 AS (SELECT g.query_id, min(h.rank) AS r FROM gd g LEFT JOIN hits h ON h.query_id = g.query_id AND h.item_id = g.item_id GROUP BY 1), k AS (SELECT g1.*, CASE WHEN length(text) > 250 THEN 'long' ELSE 'short' END AS kind FROM g1 JOIN benchmark b ON b.item_id = query_id)
SELECT kind, count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1e0 ELSE 0e0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1e0 ELSE 0e0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 20 THEN 1e0 ELSE 0e0 END), 6) AS recall_20, round(avg(coalesce(1e0 / r, 0e0)), 6) AS mrr FROM k GROUP BY ROLLUP (kind)""")
def recall_mrr(spark, sf):
    return ev.recall_mrr(hits(spark, sf, False), gold(spark, sf), kinds(spark, sf))


@query("paired_test", f"""WITH {COMPARE}, c AS (SELECT count(*) AS pairs, count(*) FILTER (change = 'improved') AS gained, count(*) FILTER (change = 'regressed') AS lost FROM cp)
SELECT pairs, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1e0 ELSE least(1e0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2e0))))) END, 6) AS p_value FROM c""")
def paired_test(spark, sf):
    return ev.paired_test(ev.compare_runs(_run(spark, sf), _other_run(spark, sf)))


_CONST = [1, 3, 10, 60]


@query("rrf_sweep", f"""WITH {SIDES_SQL}, {GOLD}, ks AS (SELECT unnest({_CONST}) AS rrf_k),
g AS (SELECT rrf_k, query_id, text_key, sum(1e0 / (rrf_k + rank)) AS rrf, min(rank) FILTER (side = 0) AS dr, min(rank) FILTER (side = 1) AS lr FROM sides, ks GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY rrf_k, query_id ORDER BY round(rrf, 9) DESC, dr NULLS LAST, lr NULLS LAST) AS rank FROM g),
f AS (SELECT k.rrf_k, q.query_id, (SELECT min(rank) FROM c JOIN gd USING (query_id, text_key) WHERE c.rrf_k = k.rrf_k AND c.query_id = q.query_id AND rank <= 5) AS r FROM ks k, (SELECT DISTINCT query_id FROM gd) q)
SELECT rrf_k, count(*) AS questions, round(avg(CASE WHEN r IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS recall, round(avg(coalesce(1e0 / r, 0e0)), 6) AS mrr FROM f GROUP BY 1""")
def rrf_sweep(spark, sf):
    dense, lex = both_sides(spark, sf)
    return ev.rrf_sweep(dense, lex, gold(spark, sf), _CONST, 5)


@query("failure_source", f"""WITH {HITS_SQL}, {GOLD}, g1 AS (SELECT g.query_id, min(h.rank) AS r FROM gd g LEFT JOIN hits h ON h.query_id = g.query_id AND h.item_id = g.item_id AND h.rank <= 1 GROUP BY 1), w AS (SELECT CASE WHEN r IS NULL THEN 'retrieval' ELSE 'generation' END AS cause FROM g1 WHERE query_id % 4 <> 0)
SELECT cause, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM w) AS DOUBLE), 6) AS share FROM w GROUP BY 1""")
def failure_source(spark, sf):
    run = questions(spark, sf).select(F.col("query_id").alias("id"), (F.col("query_id") % 4 == 0).alias("correct"))
    return ev.failure_source(run, hits(spark, sf, False).filter("rank <= 1"), gold(spark, sf))


# ---------------------------------------------------------------- inventory


@query("folder_group", f"WITH {FILES} SELECT page_id, \"group\" FROM fc")
def folder_group(spark, sf):
    return files(spark, sf).select("page_id", "group")


@query("file_bucket", f"WITH {FILES} SELECT page_id, bucket FROM fc")
def file_bucket(spark, sf):
    return files(spark, sf).select("page_id", "bucket")


ROLLUP = f"""{FILES}, ro AS (SELECT "group", count(*) FILTER (bucket <> '무시') AS files, CAST(coalesce(sum(size) FILTER (bucket <> '무시'), 0) AS BIGINT) AS bytes, count(*) FILTER (bucket = '지원') AS supported, count(*) FILTER (bucket = '변환필요') AS needs_work, count(*) FILTER (bucket = '무시') AS ignored, count(*) FILTER (bucket = '기타') AS other,
  max(mtime) FILTER (bucket <> '무시') AS newest, min(mtime) FILTER (bucket <> '무시') AS oldest FROM fc GROUP BY 1)"""


@query("folder_rollup", f"""WITH {ROLLUP}, ex AS (SELECT "group", string_agg(ext || ':' || n, ' ' ORDER BY ext) AS exts FROM (SELECT "group", ext, count(*) AS n FROM fc WHERE bucket <> '무시' GROUP BY 1, 2) GROUP BY 1),
sm AS (SELECT "group", string_agg(name, ' / ' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY name, path) AS r FROM fc WHERE bucket <> '무시') WHERE r <= 8 GROUP BY 1)
SELECT ro.*, coalesce(exts, '') AS exts, coalesce(samples, '') AS samples FROM ro LEFT JOIN ex USING ("group") LEFT JOIN sm USING ("group")""")
def folder_rollup(spark, sf):
    return inv.folder_rollup(files(spark, sf))


@query("subfolders", f"""WITH {FILES}, d AS (SELECT DISTINCT '/share/' || folders[1] AS "group", folders[2] AS sub FROM fc WHERE len(folders) > 1) SELECT "group", count(*) AS subfolders, array_to_string(list(sub ORDER BY sub)[1:5], ' / ') AS first_subfolders FROM d GROUP BY 1""")
def subfolders(spark, sf):
    return inv.subfolders(inv.classified(listing(spark, sf), "/share", 1), 1)


_words = "[" + ", ".join(quoted(h) for h in inv.HINTS) + "]"


@query("sensitive_hints", f"WITH {FILES} SELECT DISTINCT \"group\", hint FROM (SELECT *, unnest({_words}) AS hint FROM fc) WHERE contains('/share/' || array_to_string(folders, '/'), hint) OR (bucket <> '무시' AND contains(name, hint))")
def sensitive_hints(spark, sf):
    return inv.sensitive_hints(files(spark, sf), "/share")


def bare_sql(name):
    out = f"regexp_replace({name}, '^(\\.*[^.].*?)\\.[^.]*$', '\\1')"
    for _ in range(6):
        out = strip_sql(f"regexp_replace({out}, {quoted('(?i)' + inv.VERSION_MARK)}, '', 'g')")
    return f"lower(regexp_replace({out}, '\\s+', '', 'g'))"


@query("normalize_name", f"WITH {FILES} SELECT page_id, {bare_sql('name')} AS bare_name FROM fc")
def normalize_name(spark, sf):
    return files(spark, sf).select("page_id", inv.normalize_name(F.col("name")).alias("bare_name"))


DUPS = f"{FILES}, dp AS (SELECT {bare_sql('name')} AS bare_name, size, count(*) AS files, size * (count(*) - 1) AS wasted_bytes FROM fc WHERE bucket IN ('지원', '변환필요') GROUP BY 1, 2 HAVING count(*) > 1)"


@query("duplicate_groups", f"WITH {DUPS} SELECT * FROM dp")
def duplicate_groups(spark, sf):
    return inv.duplicate_groups(files(spark, sf))


@query("extension_top", f"WITH {FILES} SELECT ext, count(*) AS files FROM fc WHERE bucket <> '무시' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def extension_top(spark, sf):
    return inv.extension_top(files(spark, sf))


@query("recency_flag", f"WITH {ROLLUP} SELECT \"group\", strftime(make_timestamp(newest * 1000000), '%Y-%m-%d') AS newest_day, newest >= {AS_OF} - 1095 * 86400 AS recent FROM ro WHERE files > 0")
def recency_flag(spark, sf):
    return inv.recency_flag(inv.folder_rollup(files(spark, sf)), F.lit(AS_OF))


@query("estate_summary", f"""WITH {DUPS} SELECT count(*) FILTER (bucket <> '무시') AS total_files, round(coalesce(sum(size) FILTER (bucket <> '무시'), 0) / 1073741824e0, 6) AS total_gb, count(*) FILTER (bucket = '지원') AS supported, count(*) FILTER (bucket = '변환필요') AS needs_work, count(*) FILTER (bucket = '무시') AS ignored, count(*) FILTER (bucket = '기타') AS other,
  CAST(0 AS BIGINT) AS access_denied, count(DISTINCT "group") FILTER (bucket <> '무시') AS folder_groups, (SELECT count(*) FROM dp) AS duplicate_groups, (SELECT CAST(coalesce(sum(files), 0) AS BIGINT) FROM dp) AS duplicate_files, (SELECT round(coalesce(sum(wasted_bytes), 0) / 1073741824e0, 9) FROM dp) AS duplicate_waste_gb FROM fc""")
def estate_summary(spark, sf):
    f = files(spark, sf)
    return inv.estate_summary(f, inv.duplicate_groups(f))
