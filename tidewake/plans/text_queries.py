"""Queries over documents, pages, conversations and events as source files and operations logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import columns as col
from tidewake.functions import text as tx
from tidewake.operators import audit, devices, ops
from tidewake.plans.catalogue import register
from tidewake.plans.samples import HOUR, SQL, samples, table
from tidewake.plans.series_queries import OVER


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


_B = "(CASE k % 6 WHEN 0 THEN 'on' WHEN 1 THEN ' Yes' WHEN 2 THEN '0' WHEN 3 THEN 'ok' WHEN 4 THEN '2' ELSE 'nan' END)"


@register("x01_x03_boolish", SQL + f", b AS (SELECT _row, lower(trim({_B})) AS w FROM s) SELECT _row, w IN ('1', 'true', 't', 'yes', 'y', 'on') AS gate, CASE w WHEN 'on' THEN true WHEN 'yes' THEN true WHEN '0' THEN false WHEN 'ok' THEN true WHEN '2' THEN true ELSE true END AS timeline, CASE w WHEN '0' THEN 0.0::DOUBLE END AS audit FROM b")
def x01(spark, sf):
    word = F.expr(_B)
    return samples(spark, sf).select("_row", col.gate_flag(word).alias("gate"), col.timeline_flag(word).alias("timeline"), col.audit_flag(word).alias("audit"))


@register("x04_to_numeric", SQL + ", b AS (SELECT _row, CASE WHEN k % 3 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) || '.5' END AS w FROM s) SELECT _row, TRY_CAST(w AS DOUBLE) AS x FROM b")
def x04(spark, sf):
    word = F.when(F.col("k") % 3 == 0, "n/a").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return samples(spark, sf).select("_row", col.to_number(word).alias("x"))


@register("x05_regex_counts", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), ' (the|der|la) ')) AS articles, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM documents")
def x05(spark, sf):
    return _long(table(spark, sf, "documents").select("doc_id", tx.matches(F.col("text"), " (the|der|la) ").alias("articles"), tx.matches(F.col("text"), "[0-9]+").alias("numbers")), "articles", "numbers")


@register("x06_c01_line_kinds", """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  SELECT doc_id, count(*) FILTER (WHERE trim(line) = '') AS blank, count(*) FILTER (WHERE starts_with(trim(line), '#')) AS comment, count(*) FILTER (WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS code FROM l GROUP BY doc_id""")
def x06(spark, sf):
    kinds = table(spark, sf, "documents").select("doc_id", tx.line_kinds(F.col("text"), "shell").alias("kinds"))
    return _long(kinds.select("doc_id", *(tx.count_of(F.col("kinds"), k).alias(k) for k in ("blank", "comment", "code"))), "blank", "comment", "code")


@register("x07_branch_tokens", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, CAST(sum(CAST(contains(line, 'if') AS INT) + CAST(contains(line, 'for') AS INT) + CAST(contains(line, 'or') AS INT)) AS BIGINT) AS branches FROM l GROUP BY doc_id")
def x07(spark, sf):
    return _long(table(spark, sf, "documents").select("doc_id", tx.branch_tokens(F.col("text"), ("if", "for", "or")).alias("branches")), "branches")


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@register("x08_path_parts", f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS top, CASE WHEN len(string_split(path, '/')) < 2 THEN '.' ELSE array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') END AS key2 FROM p")
def x08(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return pages.select("page_id", tx.top_directory(F.col("path")).alias("top"), tx.directory_key(F.col("path"), 2).alias("key2"))


@register("x09_s06_clamp_units", SQL + " SELECT run_id, _row, round(CASE WHEN abs(value / 50) > 5 THEN 0.0 ELSE value / 50 END, 6) AS a, round(CASE WHEN abs(value * 20) > 5000 THEN 0.0 ELSE value * 20 END, 6) AS b, round(CASE WHEN abs(value / 3) > 100 THEN 0.0 ELSE value / 3 END, 6) AS c FROM s")
def x09(spark, sf):
    v = F.col("value")
    rows = col.clamp_by_unit(samples(spark, sf).select("run_id", "_row", (v / 50).alias("a(m_s)"), (v * 20).alias("b(mm_s)"), (v / 3).alias("c(m)")))
    return rows.select("run_id", "_row", F.round("`a(m_s)`", 6).alias("a"), F.round("`b(mm_s)`", 6).alias("b"), F.round("`c(m)`", 6).alias("c"))


@register("x10_unit_parse", SQL + ", b AS (SELECT _row, CASE WHEN k % 4 = 0 THEN 'bad' WHEN k % 4 = 1 THEN k || '.25V' ELSE '-' || k || 'A' END AS w FROM s) SELECT _row, TRY_CAST(nullif(regexp_extract(w, '^([+-]?[0-9]+(\\.[0-9]+)?)\\s*([A-Za-z%]+)$', 1), '') AS DOUBLE) AS x, nullif(regexp_extract(w, '^([+-]?[0-9]+(\\.[0-9]+)?)\\s*([A-Za-z%]+)$', 3), '') AS unit FROM b")
def x10(spark, sf):
    k = F.col("k").cast("string")
    word = F.when(F.col("k") % 4 == 0, "bad").when(F.col("k") % 4 == 1, F.concat(k, F.lit(".25V"))).otherwise(F.concat(F.lit("-"), k, F.lit("A")))
    return samples(spark, sf).select("_row", tx.number_and_unit(word).alias("p")).select("_row", F.col("p.value").alias("x"), "p.unit")


@register("x11_token_scan", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), '<([a-z]+)', 1))), ',') AS tags FROM pages")
def x11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(tx.distinct_tokens(F.col("html"), "<([a-z]+)"), ",").alias("tags"))


@register("x13_iso_time", SQL + ", b AS (SELECT _row, k, CASE WHEN k % 5 = 0 THEN 'later' ELSE '2024-01-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || ' 10:00:00' END AS w FROM s) SELECT _row, epoch_us(TRY_CAST(w AS TIMESTAMP)) // 1000000 AS sec FROM b")
def x13(spark, sf):
    day = F.lpad((1 + F.col("k") % 28).cast("string"), 2, "0")
    word = F.when(F.col("k") % 5 == 0, "later").otherwise(F.concat(F.lit("2024-01-"), day, F.lit(" 10:00:00Z")))
    return samples(spark, sf).select("_row", F.unix_seconds(tx.iso_time(word)).alias("sec"))


@register("x14_s12_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x14(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@register("x16_bitmask", SQL + " SELECT _row, (k & 4) <> 0 AS third, (k | 8) AS with_fourth, (k & ~1) AS without_first FROM s")
def x16(spark, sf):
    k = F.col("k")
    return samples(spark, sf).select("_row", tx.has_flag(k, 2).alias("third"), k.bitwiseOR(F.lit(8)).alias("with_fourth"), k.bitwiseAND(F.lit(~1)).alias("without_first"))


@register("x17_pad_arrays", SQL + " SELECT _row, gx AS r0, CASE WHEN k % 3 > 0 THEN gy END AS r1, CASE WHEN k % 3 > 1 THEN gz END AS r2 FROM s")
def x17(spark, sf):
    values = F.slice(F.array("gx", "gy", "gz"), F.lit(1), (F.col("k") % 3 + 1).cast("int"))
    return samples(spark, sf).select("_row", *(c.alias(f"r{i}") for i, c in enumerate(tx.padded(values, 3))))


@register("x18_operator_summary", SQL + " SELECT _row, CASE WHEN k % 7 = 0 THEN 'reconnecting' WHEN k % 5 = 0 THEN 'offline' WHEN k % 3 = 0 THEN 'stale' WHEN NOT valid THEN 'invalid' ELSE 'ok' END AS label FROM s")
def x18(spark, sf):
    k = F.col("k")
    return samples(spark, sf).select("_row", col.first_reason([("reconnecting", k % 7 == 0), ("offline", k % 5 == 0), ("stale", k % 3 == 0), ("invalid", ~F.col("valid"))], "ok").alias("label"))


# --- audit -------------------------------------------------------------------------------------


def _files(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


@register("a31_c09_loc_totals", "WITH l AS (SELECT lang, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT lang, source, count(*) FILTER (WHERE trim(line) <> '') AS code, count(*) FILTER (WHERE trim(line) = '') AS blank FROM l GROUP BY ROLLUP (lang, source)")
def a31(spark, sf):
    sizes = audit.file_sizes(_files(spark, sf)).select("code", "blank", F.split("path", "/").alias("p"))
    return sizes.select("code", "blank", F.get("p", F.lit(1)).alias("lang"), F.get("p", F.lit(0)).alias("source")).rollup("lang", "source").agg(F.sum("code").alias("code"), F.sum("blank").alias("blank"))


@register("a32_dir_rollup", "WITH l AS (SELECT source || '/' || lang AS directory, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), f AS (SELECT directory, doc_id, count(*) FILTER (WHERE trim(line) <> '') AS code FROM l GROUP BY directory, doc_id) SELECT directory, count(*) AS files, CAST(sum(code) AS BIGINT) AS code, max(code) AS largest FROM f GROUP BY directory")
def a32(spark, sf):
    return _long(audit.directory_rollup(audit.file_sizes(_files(spark, sf)), 2).drop("branches"), "largest")


@register("c03_risk_score", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), f AS (SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS code, max(length(line)) AS longest FROM l GROUP BY doc_id) SELECT doc_id, CAST(code + 15 * longest + CASE WHEN code > 200 THEN 200 ELSE 0 END AS BIGINT) AS score FROM f")
def c03(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", tx.count_of(tx.line_kinds(F.col("text"), "other"), "code").alias("code"), F.array_max(F.transform(tx.lines(F.col("text")), F.length)).alias("longest"))
    return _long(rows.select("doc_id", audit.risk_score(F.col("code"), F.col("longest"), F.lit(0), F.lit(0), F.lit(0)).alias("score")), "score")


def _count_sql(text, patterns):
    return " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns)


_SOURCE = "CASE page_id % 3 WHEN 0 THEN 'cpp' WHEN 1 THEN 'py' ELSE 'md' END"
_BODY = "replace(replace(coalesce(html, ''), '<', ' new memcpy('), '>', ' hack os.system( Telemetry ')"


@register("c05_pattern_scan", f"""WITH f AS (SELECT page_id, {_SOURCE} AS ext, {_BODY} AS x FROM pages),
  c AS (SELECT page_id, {_count_sql("x", [audit.TODO])} AS todo, CASE ext WHEN 'cpp' THEN {_count_sql("x", ["\\b(?:" + "|".join(audit.C_CALLS) + ")\\b"])} ELSE 0 END AS unsafe_c, CASE ext WHEN 'cpp' THEN {_count_sql("x", audit.CPP_PATTERNS)} ELSE 0 END AS unsafe_cpp,
          CASE ext WHEN 'py' THEN {_count_sql("x", audit.PY_PATTERNS)} ELSE 0 END AS unsafe_py, {_count_sql("x", audit.CRITICAL_WORDS)} AS critical, length(x) AS n FROM f)
  SELECT page_id, todo, unsafe_c, unsafe_cpp, unsafe_py, critical, 5 * todo + 8 * unsafe_c + 6 * unsafe_cpp + 6 * unsafe_py + CAST(critical > 0 AS INT) AS score FROM c WHERE n > 0""")
def c05(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.lit("."), F.expr(_SOURCE)).alias("path"), F.expr(_BODY).alias("text"))
    rows = audit.pattern_hits(files).withColumn("page_id", F.regexp_extract("path", "src/([0-9]+)", 1).cast("long"))
    names = ("todo", "unsafe_c", "unsafe_cpp", "unsafe_py", "critical", "score")
    return _long(rows.select("page_id", *names), *names)


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@register("c06_a33_include_matrix", f"WITH e AS (SELECT split_part({_HOST}, '.', 1) AS module, unnest(regexp_extract_all(coalesce(html, ''), '<(nav|ul|title|p|script|style|div|article)[ >]', 1)) AS target FROM pages), c AS (SELECT module, target, count(*) AS n FROM e GROUP BY module, target) SELECT module, CAST(coalesce(sum(n) FILTER (WHERE target = 'nav'), 0) AS BIGINT) AS nav, CAST(coalesce(sum(n) FILTER (WHERE target = 'p'), 0) AS BIGINT) AS p, CAST(coalesce(sum(n) FILTER (WHERE target = 'title'), 0) AS BIGINT) AS title FROM c GROUP BY module")
def c06(spark, sf):
    edges = table(spark, sf, "pages").select(F.element_at(F.split(F.expr(_HOST), r"\."), 1).alias("module"), F.explode(tx.extracted(F.col("html"), "<(nav|ul|title|p|script|style|div|article)[ >]")).alias("target"))
    counts = edges.groupBy("module", "target").agg(F.count("*").alias("n"))
    return audit.include_matrix(counts, ["nav", "p", "title"])


@register("c07_cycles", """WITH RECURSIVE n AS (SELECT DISTINCT c_nationkey % 9 AS module, (2 * c_nationkey + c_custkey % 3) % 9 AS target FROM customer),
  p AS (SELECT module AS first, target AS last, [module, target] AS path FROM n WHERE target > module
        UNION ALL SELECT p.first, n.target, list_append(p.path, n.target) FROM p JOIN n ON p.last = n.module WHERE n.target > p.first AND NOT list_contains(p.path, n.target))
  SELECT DISTINCT array_to_string(path, '>') AS cycle, CAST(len(path) AS BIGINT) AS length FROM p JOIN n ON p.last = n.module AND n.target = p.first WHERE len(path) >= 3""")
def c07(spark, sf):
    edges = table(spark, sf, "customer").select((F.col("c_nationkey") % 9).alias("module"), ((2 * F.col("c_nationkey") + F.col("c_custkey") % 3) % 9).alias("target"))
    return _long(audit.cycles(edges), "length")


@register("c08_git_hotspots", "SELECT 'src/' || source || '.py' AS path, count(*) AS changes FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY changes DESC, path LIMIT 10")
def c08(spark, sf):
    return audit.hotspots(table(spark, sf, "documents").select(F.concat(F.lit("M\tsrc/"), F.col("source"), F.lit(".py")).alias("value")), 10)


@register("j11_merge_by_key", "SELECT d.doc_id, l.quality, length(coalesce(text, '')) AS size FROM documents d LEFT JOIN labels l USING (doc_id)")
def j11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


# --- operations --------------------------------------------------------------------------------


@register("j13_o01_static_score", "SELECT s_suppkey, r_name, round(least(0.95, CASE WHEN s_nationkey = r_regionkey THEN 0.55 ELSE 0 END + CASE WHEN s_suppkey % 5 = r_regionkey THEN 0.15 ELSE 0 END + CASE WHEN s_acctbal > 5000 AND r_regionkey = 1 THEN 0.20 ELSE 0 END + CASE WHEN contains(s_name, '7') AND r_regionkey = 2 THEN 0.10 ELSE 0 END), 6)::DOUBLE AS score FROM supplier, region WHERE s_nationkey = r_regionkey OR s_suppkey % 5 = r_regionkey OR (s_acctbal > 5000 AND r_regionkey = 1) OR (contains(s_name, '7') AND r_regionkey = 2)")
def j13(spark, sf):
    r = F.col("r_regionkey")
    score = ops.static_score(F.col("s_nationkey") == r, F.col("s_suppkey") % 5 == r, (F.col("s_acctbal") > 5000) & (r == 1), [F.col("s_name").contains("7") & (r == 2)])
    return ops.rule_scores(table(spark, sf, "supplier"), table(spark, sf, "region"), F.round(score, 6)).select("s_suppkey", "r_name", "score")


_SCORES = "sc AS (SELECT user_id AS identity, event_type AS type, round(max(value) / 500, 3) AS score FROM events GROUP BY user_id, event_type)"


def _scores(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("identity"), F.col("event_type").alias("type")).agg(F.round(F.max("value") / 500, 3).alias("score"))


_RESOLVED = f"WITH {_SCORES}, rk AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY identity ORDER BY score DESC, type)), re AS (SELECT identity, score, CASE WHEN score < 0.6 THEN 'unknown' WHEN score - second <= 0.12 + 1e-9 AND second >= 0.6 THEN 'ambiguous' ELSE type END AS type FROM rk WHERE rank = 1)"


# Captured samples: each event as a line or a header of one of the devices, by its k.
_SAMPLE = r"""CASE k % 13 WHEN 0 THEN concat('Timestamp(s),SensorID,RawLine', chr(10), '1,DVL_H1000,":BE,', k, ',V"') WHEN 1 THEN concat(':TS,1', chr(10), ':BI,2', chr(10), ':bd , 3:SA,', k) WHEN 2 THEN concat(':BS,', k)
  WHEN 3 THEN 'CS 1' WHEN 4 THEN 'MonoNS,EstNS,AccX,AccY,AccZ,AsX,AsY,AsZ,HX,HY,HZ,AngX,AngY,AngZ,TemperatureC' WHEN 5 THEN concat(chr(10), '"accx",accy,AccZ,AsX,AsY,AsZ,HX,HY,HZ,AngX,AngY,AngZ', chr(10), k)
  WHEN 6 THEN 'ax(g)	ay(g)	az(g)	wx(deg/s)	wy(deg/s)	wz(deg/s)	AngleX(deg)	AngleY(deg)	AngleZ(deg)	magx	magy	magz'
  WHEN 7 THEN concat('Timestamp,CH0,CH1,CH2,CH3,CH4,CH5,CH6,CH7,CH8,CH9,CH10,CH11,CH12,CH13,CH14,CH15', chr(10), 't,', k, 'V,0.000A') WHEN 8 THEN concat('CH0,CH1,CH2,CH3,CH4,CH5,CH6,CH7,CH8,CH9,CH10,CH11,CH12,CH13,CH14,CH15', chr(10), k, 'V,2')
  WHEN 9 THEN concat('CH0: 1.5 V', chr(10), 'CH1: 2', chr(10), 'ch2:3', chr(10), 'CH3: ', k, chr(10), ':BE,1') WHEN 10 THEN 'a usbl beacon'
  WHEN 11 THEN repeat(concat('UQ', chr(k + 1), repeat(chr(16), 7), chr(k + 23)), 1 + k % 4) ELSE 'heartbeat: 42' END"""
_HEAD = "list_transform(string_split_regex(trim(string_split(ltrim(x, chr(10)), chr(10))[1]), CASE WHEN contains(string_split(ltrim(x, chr(10)), chr(10))[1], ',') THEN ',' ELSE chr(9) END), lambda y: lower(trim(trim(y), '\"')))"
_ALL = lambda names: "list_has_all(h, [" + ", ".join(f"'{n.lower()}'" for n in names) + "])"


@register("o02_sample_classify", SQL + f""", x0 AS (SELECT _row, {_SAMPLE} AS x, CASE WHEN k % 13 = 11 THEN 1 + k % 4 ELSE 0 END AS m FROM s), x1 AS (SELECT _row, x, m, {_HEAD} AS h, list_sort(list_distinct(list_transform(regexp_extract_all(x, '{devices.DVL_REPLY}', 1), lambda y: upper(y)))) AS tok,
    list_distinct(regexp_extract_all(x, '{devices.CHANNEL_LINE}', 1)) AS ch, len(list_filter(regexp_extract_all(x, '{devices.CHANNEL_LINE}', 2), lambda y: y <> '')) > 0 AS marked,
    list_distinct(list_filter(list_transform(string_split(replace(substr(x, strpos(x, chr(10)) + 1), chr(10), ','), ','), lambda y: upper(regexp_extract(y, '{devices.CELL_UNIT}', 1))), lambda y: y <> '' AND contains(x, chr(10)))) AS u FROM x0),
  x2 AS (SELECT *, CASE WHEN {_ALL(devices.DVL_EXPORT)} THEN CASE WHEN regexp_matches(x, '{devices.DVL_SENSOR}') THEN 0.78 ELSE 0.74 END ELSE 0 END AS dh, CASE WHEN len(tok) >= 3 THEN least(0.94, 0.78 + 0.03 * len(tok)) WHEN len(tok) = 2 THEN 0.82 WHEN len(tok) = 1 THEN 0.68 ELSE 0 END AS dt,
    CASE WHEN len(list_filter(h, lambda y: regexp_full_match(y, 'ch[0-9]+'))) >= 16 THEN 0.78 + CASE WHEN h[1] IN ('timestamp', 'monons') THEN 0.04 ELSE 0 END + CASE WHEN list_has_all(u, ['A', 'V']) THEN 0.05 WHEN len(u) > 0 THEN 0.02 ELSE 0 END ELSE 0 END AS vh,
    CASE WHEN len(ch) >= 4 THEN least(0.82, 0.66 + 0.02 * least(len(ch), 8)) + CASE WHEN marked THEN 0.04 ELSE 0 END ELSE 0 END AS vl,
    CASE WHEN {_ALL(devices.IMU_EXPORT)} THEN 0.84 + CASE WHEN {_ALL(devices.IMU_TIME)} THEN 0.03 ELSE 0 END WHEN {_ALL(devices.IMU_ARCHIVE)} THEN 0.78 ELSE 0 END AS im, CASE WHEN m >= 2 THEN least(0.62, 0.50 + 0.03 * m) ELSE 0 END AS fr FROM x1),
  r AS (SELECT _row, 'dvl' AS type, CASE WHEN greatest(dh, dt) > 0 THEN greatest(dh, dt) WHEN regexp_matches(x, '{devices.DVL_COMMAND}') THEN 0.40 ELSE 0 END AS score, CASE WHEN greatest(dh, dt) > 0 THEN 'sample_backed' ELSE 'candidate_only' END AS support,
        CASE WHEN greatest(dh, dt) = 0 THEN 'dvl_command_echo_only' WHEN len(tok) > 0 AND dt >= dh THEN 'dvl_reply_tokens' ELSE 'dvl_export_rawline_csv' END AS detector, array_to_string(tok, ',') AS evidence FROM x2
    UNION ALL SELECT _row, 'volt32', least(0.89, greatest(vh, vl)), CASE WHEN vl > 0 AND vl >= vh THEN 'partial' ELSE 'sample_backed' END, CASE WHEN vl > 0 AND vl >= vh THEN 'volt32_channel_lines' ELSE 'volt32_export_csv' END, array_to_string(list_sort(u), ',') FROM x2
    UNION ALL SELECT _row, 'imu', least(0.89, greatest(im, fr)), CASE WHEN fr > 0 AND fr >= im THEN 'candidate_only' ELSE 'sample_backed' END, CASE WHEN fr > 0 AND fr >= im THEN 'imu_legacy_wit_sync' WHEN {_ALL(devices.IMU_EXPORT)} THEN 'imu_export_csv' ELSE 'imu_archive_text' END,
        concat_ws(',', CASE WHEN {_ALL(devices.IMU_EXPORT)} THEN 'export' END, CASE WHEN {_ALL(devices.IMU_ARCHIVE)} THEN 'archive' END, CASE WHEN fr > 0 THEN 'frames' END) FROM x2
    UNION ALL SELECT _row, 'usbl', CASE WHEN regexp_matches(x, '{devices.USBL}') THEN 0.6 ELSE 0 END, 'candidate_only', 'usbl_ascii_token', 'USBL' FROM x2)
  SELECT _row, type, round(CAST(score AS DOUBLE), 6) AS score, support, detector, evidence FROM r WHERE score > 0""")
def o02(spark, sf):
    rows = samples(spark, sf).select(F.col("_row").alias("identity"), F.encode(F.expr(_SAMPLE.replace("\t", "\\t")), "UTF-8").alias("content"))
    return devices.classified(rows).select(F.col("identity").alias("_row"), "type", F.round("score", 6).alias("score"), "support", "detector", "evidence")


@register("o04_resolve", _RESOLVED + " SELECT identity, type, score FROM re")
def o04(spark, sf):
    return ops.resolved(_scores(spark, sf))


@register("a35_best_binding", _RESOLVED + ", b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, identity) AS i FROM re WHERE type NOT IN ('unknown', 'ambiguous')) SELECT type, identity, score FROM b WHERE i = 1")
def a35(spark, sf):
    return ops.best_bindings(ops.resolved(_scores(spark, sf))).select("type", "identity", "score")


@register("a34_device_counts", _RESOLVED + ", d AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'unknown']) AS type), c AS (SELECT CASE type WHEN 'ambiguous' THEN 'unknown' ELSE type END AS type, count(*) AS n FROM re GROUP BY 1) SELECT type, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (type)")
def a34(spark, sf):
    return ops.device_counts(ops.resolved(_scores(spark, sf)), ["view", "click", "signup", "purchase", "error", "unknown"])


@register("j14_missing_set", "SELECT DISTINCT c_nationkey AS type FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000)")
def j14(spark, sf):
    required = table(spark, sf, "customer").select(F.col("c_nationkey").alias("type")).distinct()
    have = table(spark, sf, "supplier").filter("s_acctbal > 6000").groupBy(F.col("s_nationkey").alias("type")).agg(F.count("*").alias("n"))
    return ops.missing_devices(required, have)


@register("o03_merge_scores", "WITH e AS (SELECT user_id AS identity, event_type AS type, max(value) / 500 AS best, count(DISTINCT event_id % 2) AS sources FROM events WHERE value > 300 GROUP BY 1, 2) SELECT identity, type, round(least(0.99, best + CASE WHEN sources > 1 THEN 0.12 ELSE 0 END), 6) AS score FROM e")
def o03(spark, sf):
    e = table(spark, sf, "events").filter("value > 300").select(F.col("user_id").alias("identity"), F.col("event_type").alias("type"), (F.col("value") / 500).alias("score"), (F.col("event_id") % 2).cast("string").alias("source"), F.array(F.col("event_type")).alias("evidence"))
    return ops.merged_scores(e).select("identity", "type", F.round("score", 6).alias("score"))


@register("o05_profile_choice", "WITH g AS (SELECT user_id AS run_id, bool_or(event_type = 'view' AND value > 400) AS i, bool_or(event_type = 'purchase' AND value > 300) AS d, bool_or(event_type = 'error' AND value > 300) AS p, bool_or(event_type = 'signup' AND value > 450) AS u FROM events GROUP BY user_id) SELECT run_id, CASE WHEN i AND d AND p AND u THEN 'full_stack' WHEN i AND d AND p THEN 'nav_power' WHEN i AND d THEN 'nav' WHEN i THEN 'imu_only' WHEN p THEN 'power_only' ELSE 'no_sensor' END AS profile FROM g")
def o05(spark, sf):
    has = lambda kind, v: F.bool_or((F.col("event_type") == kind) & (F.col("value") > v))
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(has("view", 400).alias("i"), has("purchase", 300).alias("d"), has("error", 300).alias("p"), has("signup", 450).alias("u"))
    return g.select("run_id", ops.profile(F.col("i"), F.col("d"), F.col("p"), F.col("u")).alias("profile"))


@register("j16_incident_window", SQL + ", a AS (SELECT run_id, t_s FROM s WHERE src = 'BI' AND value > 150) SELECT run_id, _row, src = 'BI' AND value > 150 AS anchor FROM s WHERE EXISTS (SELECT 1 FROM a WHERE a.run_id = s.run_id AND s.t_s BETWEEN a.t_s - 20 * 3600.0 AND a.t_s + 10 * 3600.0)")
def j16(spark, sf):
    rows = samples(spark, sf)
    return ops.incident_window(rows.select("run_id", "_row", "t_s"), rows.filter("src = 'BI' and value > 150"), 20 * HOUR, 10 * HOUR).select("run_id", "_row", "anchor")


@register("j12_window_vs_tables", SQL + ", w AS (SELECT run_id, CAST(floor((t_s - t0) / 360000.0) AS BIGINT) AS bin, src, value FROM (SELECT *, min(t_s) OVER (PARTITION BY run_id) AS t0 FROM s)), b AS (SELECT run_id, bin FROM w GROUP BY run_id, bin HAVING avg(value) > 120) SELECT run_id, bin, round(avg(value) FILTER (WHERE src = 'BE'), 6) AS be_mean, round(avg(value) FILTER (WHERE src = 'BI'), 6) AS bi_mean, count(*) FILTER (WHERE src = 'IMU') AS n_imu FROM w JOIN b USING (run_id, bin) GROUP BY run_id, bin")
def j12(spark, sf):
    first = F.min("t_s").over(W.partitionBy("run_id"))
    rows = samples(spark, sf).withColumn("bin", F.floor((F.col("t_s") - first) / (100 * HOUR)))
    bad = rows.groupBy("run_id", "bin").agg(F.avg("value").alias("m")).filter("m > 120").select("run_id", "bin")
    of = lambda s: F.when(F.col("src") == s, F.col("value"))
    return rows.join(bad, ["run_id", "bin"]).groupBy("run_id", "bin").agg(F.round(F.avg(of("BE")), 6).alias("be_mean"), F.round(F.avg(of("BI")), 6).alias("bi_mean"), F.count(of("IMU")).alias("n_imu"))


@register("j15_newest_after", SQL + ", f AS (SELECT run_id, t_s, _row, t_s >= min(t_s) FILTER (WHERE src = 'BE') OVER (PARTITION BY run_id) - 5 AS ok FROM s WHERE value < 400 OR src = 'BE') SELECT run_id, max_by(_row, struct_pack(t := t_s, r := _row)) AS path FROM f WHERE ok GROUP BY run_id")
def j15(spark, sf):
    rows = samples(spark, sf)
    starts = rows.filter("src = 'BE'").groupBy("run_id").agg(F.min("t_s").alias("start"))
    return ops.newest_after(rows.filter("value < 400 or src = 'BE'").select("run_id", F.col("t_s").alias("mtime"), F.col("_row").alias("path")), starts)


@register("a36_o06_completeness", "WITH h AS (SELECT conv_id AS bundle, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(role = 'system') AS s FROM conversations GROUP BY conv_id) SELECT bundle, array_to_string(list_filter([CASE WHEN NOT u THEN 'user' END, CASE WHEN NOT a THEN 'assistant' END], lambda x: x IS NOT NULL), ',') AS missing_required, CASE WHEN s THEN '' ELSE 'system' END AS missing_optional, CASE WHEN NOT u OR NOT a THEN 'failed' WHEN NOT s THEN 'incomplete' ELSE 'complete' END AS status FROM h")
def a36(spark, sf):
    return ops.completeness(table(spark, sf, "conversations").select(F.col("conv_id").alias("bundle"), F.col("role").alias("artifact")), ["user", "assistant"], ["system"])


@register("d01_merge_timeline", SQL + ", m AS (SELECT run_id, t_s, _row, event_type AS what, 'nav' AS log FROM s WHERE src = 'IMU' UNION ALL SELECT run_id, t_s, _row, CAST(k AS VARCHAR), 'control' FROM s WHERE src <> 'IMU') SELECT run_id, log, what, _row, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS place FROM m")
def d01(spark, sf):
    nav = samples(spark, sf, "IMU").withColumn("what", F.col("event_type"))
    control = samples(spark, sf, "BE", "BI").withColumn("what", F.col("k"))
    rows = ops.merged_timeline({"nav": nav, "control": control})
    return rows.select("run_id", "log", "what", "_row", F.row_number().over(W.partitionBy("run_id").orderBy("t_s", "_row")).cast("long").alias("place"))


@register("d03_replay_compare", SQL + ", a AS (SELECT run_id, src, k // 25 AS sig, count(*) AS n_a FROM s WHERE k % 50 <> 3 GROUP BY 1, 2, 3), b AS (SELECT run_id, src, k // 25 AS sig, count(*) AS n_b FROM s WHERE k % 50 <> 7 GROUP BY 1, 2, 3) SELECT run_id, src, sig, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (run_id, src, sig) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)")
def d03(spark, sf):
    rows = samples(spark, sf).withColumn("sig", F.floor(F.col("k") / 25).cast("int"))
    return ops.replay_differences(rows.filter("k % 50 <> 3"), rows.filter("k % 50 <> 7"), ["run_id", "src", "sig"])


@register("r03_newer_only", SQL + ", o AS (SELECT *, max(t_s) OVER (PARTITION BY run_id ORDER BY value, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s) SELECT run_id, _row FROM o WHERE newest IS NULL OR t_s > newest")
def r03(spark, sf):
    newest = F.max("t_s").over(W.partitionBy("run_id").orderBy("value", "_row").rowsBetween(W.unboundedPreceding, -1))
    return samples(spark, sf).withColumn("newest", newest).filter("newest is null or t_s > newest").select("run_id", "_row")


@register("r04_staleness", SQL + f", g AS (SELECT *, coalesce(t_s - lag(t_s) OVER ({OVER}), 0) + 1800 AS age FROM s) SELECT run_id, _row, round(age, 6) AS age, age > 20 * 3600.0 AS stale, CASE WHEN age <= 20 * 3600.0 THEN value END AS payload FROM g")
def r04(spark, sf):
    from tidewake.operators import timeseries as ts

    rows = samples(spark, sf).withColumn("age", F.coalesce(ts.step(F.col("t_s")), F.lit(0.0)) + 1800)
    stale = F.col("age") > 20 * HOUR
    return rows.select("run_id", "_row", F.round("age", 6).alias("age"), stale.alias("stale"), F.when(~stale, F.col("value")).alias("payload"))


@register("r08_ring_loss", SQL + ", q AS (SELECT run_id, _row, greatest(_row - lag(_row) OVER (PARTITION BY run_id ORDER BY _row) - 1, 0) AS lost FROM s) SELECT * FROM q")
def r08(spark, sf):
    rows = samples(spark, sf).withColumn("seq", F.col("_row"))
    return rows.select("run_id", "_row", F.when(F.lag("seq").over(W.partitionBy("run_id").orderBy("seq")).isNull(), F.lit(0)).otherwise(ops.lost_events(rows)).alias("lost"))


@register("r11_command_lifecycle", "WITH r AS (SELECT user_id AS run_id, event_id % 7 AS command, event_type AS state, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS rk, ts FROM events) SELECT run_id, command, max_by(state, struct_pack(a := rk, b := ts)) AS state FROM r GROUP BY run_id, command")
def r11(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("command"), F.col("event_type").alias("state"), F.col("ts").alias("t_s"))
    return ops.command_state(rows, ["view", "click", "signup", "purchase", "error"])


@register("x12_checksum_frames", SQL + " SELECT _row, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 0 END AS valid, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS loose FROM s")
def x12(spark, sf):
    k = F.col("k")
    head = F.when(k % 3 == 0, "54").otherwise("55")
    total = (0x55 + 0x51 + k + 7 * 2 + F.when(k % 2 == 0, 0).otherwise(1)) % 256
    data = F.unhex(F.concat(head, F.lit("51"), F.lpad(F.hex(k), 2, "0"), F.lit("02" * 7), F.lpad(F.hex(total), 2, "0")))
    return _long(samples(spark, sf).select("_row", tx.frames_with_checksum(data).alias("f")).select("_row", "f.valid", "f.loose"), "valid", "loose")


def _python_files(spark, sf):
    """A function of doc_id % 100 lines and one of two, a file a document."""
    body = F.repeat(F.lit("\n    pass"), (F.col("doc_id") % 100).cast("int"))
    return table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f():"), body, F.lit("\nasync def g(x):\n    if x:\n        return 1")).alias("text"))


@register("c02_function_spans", "WITH n AS (SELECT doc_id || '.py' AS path, doc_id % 100 AS n FROM documents) SELECT path, 'f' AS name, 1 AS line, n + 1 AS lines, CASE WHEN n > 0 THEN 1 ELSE 0 END AS nest FROM n UNION ALL SELECT path, 'g', n + 2, 3, 2 FROM n")
def c02(spark, sf):
    return audit.function_spans(_python_files(spark, sf))


@register("c04_long_functions", "SELECT doc_id || '.py' AS path, 'f' AS name, doc_id % 100 + 1 AS lines FROM documents WHERE doc_id % 100 + 1 >= 80")
def c04(spark, sf):
    return audit.long_functions(audit.function_spans(_python_files(spark, sf))).select("path", "name", "lines")
