"""Ingestion queries: files, markers, tags, chunks, rules, directories, over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import edits as E
from tessera.operators import embedding as B
from tessera.operators import hash_tree as H
from tessera.operators import rules as X
from tessera.operators import sync as S
from tessera.sources.sinks import backfill
from tessera.sources.tables import scoped, table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


SUFFIX = ["py", "js", "md", "txt", "html"]
FILES = """
WITH files AS (SELECT doc_id, source AS project, source || '/' || lang || '/d' || (doc_id % 7) || '/f' || doc_id || '.' || (['py', 'js', 'md', 'txt', 'html'])[doc_id % 5 + 1] AS path, (['py', 'js', 'md', 'txt', 'html'])[doc_id % 5 + 1] AS suffix, text, n_chars AS size FROM documents)"""


def files(spark, sf) -> DataFrame:
    """Documents as files of projects."""
    d = table(spark, sf, "documents")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIX)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), suffix))
    return d.select("doc_id", F.col("source").alias("project"), path.alias("path"), suffix.alias("suffix"), "text", F.col("n_chars").alias("size"))


@q("file_scan", FILES + " SELECT doc_id, path FROM files WHERE suffix IN ('py', 'js', 'md') AND NOT list_has_any(string_split(path, '/'), ['d3', 'es'])")
def file_scan(spark, sf):
    keep = F.col("suffix").isin("py", "js", "md") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("d3"), F.lit("es")))
    return files(spark, sf).where(keep).select("doc_id", "path")


@q("file_admission", FILES + " SELECT doc_id FROM files WHERE size <= 5000 AND suffix IN ('py', 'js', 'md', 'txt') AND NOT contains(path, '/d5/') AND NOT contains(path, 'src13')")
def file_admission(spark, sf):
    bad = F.col("path").contains("/d5/") | F.col("path").contains("src13")
    return files(spark, sf).where((F.col("size") <= 5000) & F.col("suffix").isin("py", "js", "md", "txt") & ~bad).select("doc_id")


RULES = ["# rules", "*/d1/*", "regex:src1[0-3]/fr", "src7/de/d2/*.md", "!deprioritize:*.txt,0.3", "!deprioritize:*/en/*,0.5"]
EXCL = "regexp_matches(path, '^.*/d1/.*$') OR regexp_matches(path, '^(src1[0-3]/fr)') OR regexp_matches(path, '^src7/de/d2/.*\\.md$')"
PEN = "greatest(CASE WHEN ends_with(path, '.txt') THEN .3 ELSE 0 END, CASE WHEN contains(path, '/en/') THEN .5 ELSE 0 END)::DOUBLE"


@q("exclusion_antijoin", FILES + f" SELECT doc_id, path FROM files WHERE NOT ({EXCL})")
def exclusion_antijoin(spark, sf):
    return X.not_excluded(files(spark, sf).select("doc_id", "path"), X.rule_table(spark, RULES))


@q("rule_penalty", FILES + f" SELECT doc_id, {PEN} AS penalty FROM files")
def rule_penalty(spark, sf):
    return X.penalties(files(spark, sf).select("doc_id", "path"), X.rule_table(spark, RULES), "doc_id").select("doc_id", "penalty")


@q("penalty_rerank", FILES + f", r AS (SELECT doc_id, round(size / 1000.0 * (1 - {PEN}), 6) AS score FROM files WHERE NOT ({EXCL})) SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 25")
def penalty_rerank(spark, sf):
    """Exclude, penalise, order."""
    rules = X.rule_table(spark, RULES)
    d = X.penalties(X.not_excluded(files(spark, sf).select("doc_id", "path", "size"), rules), rules, "doc_id")
    return d.select("doc_id", F.round(F.col("size") / 1000.0 * (1 - F.col("penalty")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


CANON = [("exact", "src0/en/d0/f0.py", "primary", 1.0), ("glob", "src0/*", "primary", 1.0), ("glob", "*/en/*", "secondary", 0.7), ("glob", "*.md", "reference", 0.4), ("glob", "*/d6/*", "deprecated", 0.1)]
CANON_SQL = FILES + """, canon AS (SELECT doc_id, path, size, CASE WHEN starts_with(path, 'src0/') THEN 'primary' WHEN contains(path, '/en/') THEN 'secondary' WHEN ends_with(path, '.md') THEN 'reference' WHEN contains(path, '/d6/') THEN 'deprecated' ELSE 'none' END AS level,
(CASE WHEN starts_with(path, 'src0/') THEN 1.0 WHEN contains(path, '/en/') THEN .7 WHEN ends_with(path, '.md') THEN .4 WHEN contains(path, '/d6/') THEN .1 ELSE .5 END)::DOUBLE AS weight FROM files)"""


def canon(spark, sf) -> DataFrame:
    """Each file's level: exact paths first, then the first pattern in order."""
    rules = [(k == "glob", X.glob_regex(p) if k == "glob" else "^" + p.replace(".", "\\.") + "$", lv, w, i) for i, (k, p, lv, w) in enumerate(CANON)]
    r = F.broadcast(spark.createDataFrame(rules, "late boolean, regex string, level string, weight double, ord int"))
    f = files(spark, sf).select("doc_id", "path", "size")
    m = f.select("doc_id", "path").join(r, F.rlike(F.col("path"), F.col("regex"))).groupBy("doc_id").agg(F.min_by(F.struct("level", "weight"), F.struct("late", "ord")).alias("m"))
    return f.join(m, "doc_id", "left").select("doc_id", "path", "size", F.coalesce("m.level", F.lit("none")).alias("level"), F.coalesce("m.weight", F.lit(0.5)).alias("weight"))


@q("canon_levels", CANON_SQL + " SELECT doc_id, level, weight, weight >= 0.7 AS canonical FROM canon")
def canon_levels(spark, sf):
    return canon(spark, sf).select("doc_id", "level", "weight", (F.col("weight") >= 0.7).alias("canonical"))


@q("canon_distribution", CANON_SQL + " SELECT level, weight, count(*) AS n, round(avg(size), 6) AS mean_size, sum(size)::BIGINT AS total_size FROM canon GROUP BY 1, 2 ORDER BY weight DESC, level")
def canon_distribution(spark, sf):
    return canon(spark, sf).groupBy("level", "weight").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.sum("size").alias("total_size")).orderBy(F.desc("weight"), "level")


@q("canon_suggestions", CANON_SQL + """, s AS (SELECT count(*) AS n, count(*) FILTER (level <> 'none') AS configured, count(*) FILTER (weight >= .7) AS canonical, count(*) FILTER (level = 'primary') AS prim, count(*) FILTER (level = 'deprecated') AS dep FROM canon)
SELECT configured = 0 AS no_config, canonical < 0.1 * n AS few_canonical, prim = 0 AS no_primary, dep > 0.2 * n AS many_deprecated FROM s""")
def canon_suggestions(spark, sf):
    n = F.count("*")
    return canon(spark, sf).agg((F.count_if(F.col("level") != "none") == 0).alias("no_config"), (F.count_if(F.col("weight") >= 0.7) < 0.1 * n).alias("few_canonical"), (F.count_if(F.col("level") == "primary") == 0).alias("no_primary"), (F.count_if(F.col("level") == "deprecated") > 0.2 * n).alias("many_deprecated"))


@q("top_canonical", CANON_SQL + " SELECT doc_id, path, size FROM canon WHERE weight >= 0.7 ORDER BY size + length(path) DESC, doc_id LIMIT 10")
def top_canonical(spark, sf):
    return canon(spark, sf).where("weight >= 0.7").orderBy(F.desc(F.col("size") + F.length("path")), "doc_id").limit(10).select("doc_id", "path", "size")


@q("pattern_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}'))::BIGINT AS {n}_count" for n, p in T.MARKERS.items()) + " FROM documents")
def pattern_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *T.marker_counts("text"))


@q("file_tags", FILES + """ SELECT doc_id, CASE WHEN contains(path, '/d6/') THEN 'archived' WHEN contains(path, '/d5/') THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN suffix = 'py' THEN 'service' WHEN suffix = 'js' THEN 'component' WHEN suffix = 'md' THEN 'documentation' ELSE 'other' END AS component,
list_slice(list_sort(list_distinct(regexp_extract_all(text, 'GNU|Apache|MIT|CC BY'))), 1, 8) AS concepts, regexp_matches(lower(text), 'http|www') AS has_io FROM files""")
def file_tags(spark, sf):
    status = F.when(F.col("path").contains("/d6/"), "archived").when(F.col("path").contains("/d5/"), "deprecated").otherwise("active")
    component = F.when(F.col("suffix") == "py", "service").when(F.col("suffix") == "js", "component").when(F.col("suffix") == "md", "documentation").otherwise("other")
    concepts = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("GNU|Apache|MIT|CC BY"), 0))), 1, 8)
    return files(spark, sf).select("doc_id", status.alias("status"), component.alias("component"), concepts.alias("concepts"), F.lower("text").rlike("http|www").alias("has_io"))


@q("file_complexity", "SELECT doc_id, round(least(1.0, len(string_split(text, chr(10))) / 500 * 0.4 + len(regexp_extract_all(text, '[.] ')) / 100 * 0.4 + len(regexp_extract_all(text, '[A-Z]')) / 200 * 0.2), 2)::DOUBLE AS complexity, (len(regexp_extract_all(text, '\\b(if|for|or|and)\\b')))::BIGINT AS keyword_complexity FROM documents")
def file_complexity(spark, sf):
    d = table(spark, sf, "documents")
    n = lambda p: F.regexp_count("text", F.lit(p))
    return d.select("doc_id", T.complexity(F.size(F.split("text", "\n")), n("[.] "), n("[A-Z]")).alias("complexity"), n(r"\b(if|for|or|and)\b").cast("long").alias("keyword_complexity"))


@q("chunk_types", """
WITH l AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS line FROM documents), w AS (SELECT doc_id, line, lower(line) AS low FROM l)
SELECT CASE WHEN starts_with(low, 'class ') THEN 'class' WHEN starts_with(low, 'def ') OR contains(low, 'function ') THEN 'function' WHEN starts_with(low, 'import ') OR starts_with(low, 'from ') THEN 'import' WHEN contains(low, 'licen') THEN 'license' WHEN starts_with(line, '#') THEN 'heading' ELSE 'text' END AS kind, count(*) AS n FROM w GROUP BY 1""")
def chunk_types(spark, sf):
    return table(spark, sf, "documents").groupBy(T.chunk_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), c AS (SELECT doc_id, pos // 5 AS chunk, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n FROM l GROUP BY 1, 2)"


@q("line_chunks", LINES + " SELECT doc_id, chunk::BIGINT AS chunk, (chunk * 5 + 1)::BIGINT AS start_line, n AS n_lines, md5(t) AS hash, length(t)::BIGINT AS n_chars FROM c WHERE trim(t, ' ') <> ''")
def line_chunks(spark, sf):
    return C.line_chunks(table(spark, sf, "documents", "doc_id", "text"), "doc_id", 5)


@q("quality_chunks", LINES + " SELECT doc_id, chunk::BIGINT AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts FROM c WHERE trim(t, ' ') <> '') WHERE parts = 1 OR length(t) >= 100")
def quality_chunks(spark, sf):
    c = line_chunks(spark, sf).withColumn("parts", F.count("*").over(Window.partitionBy("doc_id")))
    return c.where((F.col("parts") == 1) | (F.col("n_chars") >= 100)).select("doc_id", "chunk")


@q("duplicate_content", "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@q("content_ids", "SELECT doc_id, sha256(text) AS sha, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS int_id, md5(text) AS md5 FROM documents")
def content_ids(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"), T.content_id("text").alias("int_id"), F.md5("text").alias("md5"))


@q("token_estimates", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, length(text) // 4 <= 512 AS one_chunk FROM documents")
def token_estimates(spark, sf):
    n = F.floor(F.length("text") / 4)
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", n.alias("tokens"), (n <= 512).alias("one_chunk"))


@q("collection_names", "SELECT DISTINCT source AS name, 'project-' || regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS collection FROM documents")
def collection_names(spark, sf):
    d = table(spark, sf, "documents", "source", "lang").distinct()
    return d.select(F.col("source").alias("name"), F.concat(F.lit("project-"), T.slug(F.concat_ws(" ", "source", "lang"))).alias("collection")).distinct()


@q("injection_scan", "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in T.INJECTION + ["the and"]) + " AS flagged, trim(regexp_replace(regexp_replace(text, '[<>;`]', '', 'g'), '[ ]+', ' ', 'g'), ' ') AS clean FROM conversations")
def injection_scan(spark, sf):
    flag = F.lower("text").rlike("|".join(f"(?:{p})" for p in T.INJECTION + ["the and"]))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", "[<>;`]", ""), "[ ]+", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", flag.alias("flagged"), clean.alias("clean"))


@q("composite_text", FILES + " SELECT doc_id, left('[STATUS: ' || CASE WHEN contains(path, '/d6/') THEN 'archived' ELSE 'active' END || ']' || chr(10) || chr(10) || 'Type: ' || suffix || chr(10) || chr(10) || left(text, 500), 6000) AS composite FROM files")
def composite_text(spark, sf):
    status = F.when(F.col("path").contains("/d6/"), "archived").otherwise("active")
    parts = F.concat_ws("\n\n", F.concat(F.lit("[STATUS: "), status, F.lit("]")), F.concat(F.lit("Type: "), F.col("suffix")), F.substring("text", 1, 500))
    return files(spark, sf).select("doc_id", F.substring(parts, 1, 6000).alias("composite"))


DIRS = FILES + """, dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS file_count, sum(len(string_split(text, chr(10))))::BIGINT AS total_lines, sum(size)::BIGINT AS size_bytes, list_sort(list(DISTINCT suffix)) AS languages, max(doc_id) AS newest FROM files GROUP BY 1)"""


def directories(spark, sf) -> DataFrame:
    """Direct children only."""
    d = files(spark, sf).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return d.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum(F.size(F.split("text", "\n"))).alias("total_lines"), F.sum("size").alias("size_bytes"), F.array_sort(F.collect_set("suffix")).alias("languages"), F.max("doc_id").alias("newest"))


Q["dir_rollup"] = (directories, DIRS + " SELECT * FROM dirs")


@q("hierarchy_totals", DIRS + " SELECT sum(file_count)::BIGINT AS files, count(*) AS dirs, sum(total_lines)::BIGINT AS lines, (SELECT list_sort(list(DISTINCT suffix)) FROM files) AS languages FROM dirs")
def hierarchy_totals(spark, sf):
    return directories(spark, sf).agg(F.sum("file_count").alias("files"), F.count("*").alias("dirs"), F.sum("total_lines").alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"))


@q("stored_hierarchy", DIRS + " SELECT dir, file_count, total_lines, size_bytes, 'Directory: ' || dir || ' | Files: ' || file_count AS summary FROM dirs")
def stored_hierarchy(spark, sf):
    """Directories written to both stores, counts to the graph and summaries to the vectors' side, and read back from the two."""
    rows = directories(spark, sf).withColumn("summary", F.concat(F.lit("Directory: "), "dir", F.lit(" | Files: "), F.col("file_count").cast("string")))
    graph, vectors, _ = S.dual_write(rows, "dir", F.col("file_count") > 0, F.col("summary").isNotNull(), ["file_count", "total_lines", "size_bytes"], ["summary"])
    return graph.join(vectors, "dir").select("dir", "file_count", "total_lines", "size_bytes", "summary")


@q("backfilled_metadata", FILES + " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE round(least(1.0, size / 10000.0), 4) END::DOUBLE AS canon_weight, CASE WHEN doc_id % 4 = 0 THEN 'known' ELSE suffix END AS language FROM files")
def backfilled_metadata(spark, sf):
    """Nulls of stored metadata filled from what is computed now; values that are there stay."""
    f = files(spark, sf)
    old = f.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0.9).alias("canon_weight"), F.when(F.col("doc_id") % 4 == 0, "known").alias("language"))
    now = f.select("doc_id", F.round(F.least(F.lit(1.0), F.col("size") / 10000.0), 4).alias("canon_weight"), F.col("suffix").alias("language"))
    return backfill(old, now, ["doc_id"], ["canon_weight", "language"])


@q("dir_summary_text", DIRS + " SELECT dir, 'Directory: ' || dir || ' | Files: ' || file_count || ' | Lines: ' || total_lines || ' | Languages: ' || array_to_string(languages, ', ') AS summary FROM dirs")
def dir_summary_text(spark, sf):
    s = F.concat_ws(" | ", F.concat(F.lit("Directory: "), "dir"), F.concat(F.lit("Files: "), F.col("file_count").cast("string")), F.concat(F.lit("Lines: "), F.col("total_lines").cast("string")), F.concat(F.lit("Languages: "), F.array_join("languages", ", ")))
    return directories(spark, sf).select("dir", s.alias("summary"))


@q("dir_tree", DIRS + ", p AS (SELECT dir, regexp_replace(dir, '/[^/]*$', '') AS parent FROM dirs) SELECT parent, count(*) AS children, min(dir) AS first_child FROM p GROUP BY 1")
def dir_tree(spark, sf):
    return directories(spark, sf).groupBy(F.regexp_replace("dir", "/[^/]*$", "").alias("parent")).agg(F.count("*").alias("children"), F.min("dir").alias("first_child"))


@q("dir_prefix_join", DIRS + ", t AS (SELECT dir FROM dirs ORDER BY size_bytes DESC, dir LIMIT 5) SELECT t.dir, count(*) AS members, min(doc_id) AS first_id FROM t JOIN files ON starts_with(path, t.dir || '/') GROUP BY 1")
def dir_prefix_join(spark, sf):
    t = F.broadcast(directories(spark, sf).orderBy(F.desc("size_bytes"), "dir").limit(5).select("dir"))
    f = files(spark, sf).select("doc_id", "path")
    return f.join(t, F.col("path").startswith(F.concat("dir", F.lit("/")))).groupBy("dir").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"))


#: Two versions of the files of all projects: those of the first projects lose some files and have some edited.
VERSIONS = FILES + """, v AS (SELECT path, suffix AS language, size, doc_id % 365 AS modified, len(string_split(text, chr(10))) AS lines, doc_id, starts_with(project, 'src1') AS moving FROM files),
va AS (SELECT * FROM v WHERE NOT (moving AND doc_id % 11 = 3)), vb AS (SELECT * REPLACE (size + CASE WHEN moving AND doc_id % 17 = 1 THEN 1 ELSE 0 END AS size) FROM v WHERE NOT (moving AND doc_id % 13 = 5))"""
OWN = """SELECT dir, sha256('{{"file_count": ' || count(path) || ', "languages": [' || coalesce(array_to_string(list_transform(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), lambda x: '"' || x || '"'), ', '), '') || '], "last_modified": ' || coalesce(max(modified), 0) || ', "path": "' || dir || '", "size_bytes": ' || coalesce(sum(size), 0) || ', "total_lines": ' || coalesce(sum(lines), 0) || '}}') AS own
FROM (SELECT unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*/[^/]*$', ''), split_part(path, '/', 1), '']) AS dir, unnest([path, NULL, NULL, NULL]) AS path, unnest([language, NULL, NULL, NULL]) AS language, unnest([modified, NULL, NULL, NULL]) AS modified, unnest([size, NULL, NULL, NULL]) AS size, unnest([lines, NULL, NULL, NULL]) AS lines FROM {0}) GROUP BY dir"""
OWNS = VERSIONS + ", oa AS (" + OWN.format("va") + "), ob AS (" + OWN.format("vb") + ")"


def versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf)
    v = f.select("path", F.col("suffix").alias("language"), "size", (F.col("doc_id") % 365).alias("modified"), F.size(F.split("text", "\n")).cast("long").alias("lines"), "doc_id", F.col("project").startswith("src1").alias("moving"))
    moved = lambda n, r: F.col("moving") & (F.col("doc_id") % n == r)
    return v.where(~moved(11, 3)), v.where(~moved(13, 5)).withColumn("size", F.col("size") + moved(17, 1).cast("long"))


@q("merkle_diff", OWNS + " SELECT coalesce(oa.dir, ob.dir) AS dir, CASE WHEN oa.own IS NULL THEN 'added' WHEN ob.own IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM oa FULL JOIN ob ON oa.dir = ob.dir WHERE oa.own IS DISTINCT FROM ob.own")
def merkle_diff(spark, sf):
    """Changed directories: levels below equal hashes are not compared."""
    a, b = versions(spark, sf)
    return H.differing(H.tree(a), H.tree(b))


@q("merkle_diff_under", OWNS + " SELECT coalesce(oa.dir, ob.dir) AS dir, CASE WHEN oa.own IS NULL THEN 'added' WHEN ob.own IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM oa FULL JOIN ob ON oa.dir = ob.dir WHERE oa.own IS DISTINCT FROM ob.own AND starts_with(coalesce(oa.dir, ob.dir) || '/', 'src1/')")
def merkle_diff_under(spark, sf):
    """As ``merkle_diff``, within one project."""
    a, b = versions(spark, sf)
    return H.differing(H.tree(a), H.tree(b), "src1")


FOLD = "sha256(o.own || '|' || coalesce(k.kids, 0) || '|' || coalesce(k.s0, 0) || '|' || coalesce(k.s1, 0) || '|' || coalesce(k.s2, 0) || '|' || coalesce(k.s3, 0))"
KIDS = "SELECT {1} AS dir, count(*) AS kids, " + ", ".join(f"sum(('0x' || substr(hash, {1 + 15 * i}, 15))::HUGEINT) AS s{i}" for i in range(4)) + " FROM {0} GROUP BY 1"


@q("hash_tree", OWNS + f""", o AS (SELECT dir, own, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM oa), k AS (SELECT 0::BIGINT AS kids, 0::HUGEINT AS s0, 0::HUGEINT AS s1, 0::HUGEINT AS s2, 0::HUGEINT AS s3),
l3 AS (SELECT dir, {FOLD} AS hash FROM o, k WHERE depth = 3), k2 AS ({KIDS.format('l3', "regexp_replace(dir, '/[^/]*$', '')")}), l2 AS (SELECT o.dir, {FOLD} AS hash FROM o JOIN k2 k USING (dir)),
k1 AS ({KIDS.format('l2', "regexp_replace(dir, '/[^/]*$', '')")}), l1 AS (SELECT o.dir, {FOLD} AS hash FROM o JOIN k1 k USING (dir)), k0 AS ({KIDS.format('l1', "''")}), l0 AS (SELECT o.dir, {FOLD} AS hash FROM o JOIN k0 k USING (dir))
SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0""")
def hash_tree(spark, sf):
    """The tree hash of every directory."""
    return H.tree(versions(spark, sf)[0]).select("dir", "hash")


#: A second version of each document: lines edited, dropped and put in, by their number and the document's.
EDITED = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, list_filter(list_transform(l, lambda x, i: CASE WHEN (i + doc_id) % 11 = 5 THEN NULL WHEN (i + doc_id) % 7 = 3 THEN x || ' edited' WHEN (i + doc_id) % 13 = 1 THEN x || chr(10) || 'a new line' ELSE x END), lambda x: x IS NOT NULL) AS l FROM d)"""


def edited(spark, sf) -> DataFrame:
    """(doc_id, old, new)."""
    at = lambda i, n, r: (i + 1 + F.col("doc_id")) % n == r
    line = lambda x, i: F.when(at(i, 11, 5), None).when(at(i, 7, 3), F.concat(x, F.lit(" edited"))).when(at(i, 13, 1), F.concat(x, F.lit("\na new line"))).otherwise(x)
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.col("text").alias("old"), F.array_join(F.array_compact(F.transform(F.split("text", "\n", -1), line)), "\n").alias("new"))


@q("edited_texts", EDITED + " SELECT doc_id, md5(array_to_string(l, chr(10))) AS hash FROM n")
def edited_texts(spark, sf):
    """The old texts with the shortest edit scripts applied give the new ones."""
    v = edited(spark, sf)
    scripts = E.edit_scripts(v, "doc_id")
    return E.apply_scripts(v.select("doc_id", "old"), scripts, "doc_id").select("doc_id", F.md5("new").alias("hash"))


@q("edit_scripts")
def edit_scripts(spark, sf):
    """Hunks of a shortest script between two versions of each document."""
    s = E.edit_scripts(edited(spark, sf), "doc_id")
    return s.select("doc_id", "a", "b", "c", "d", F.size("put").alias("put"))


@q("rechunked")
def rechunked(spark, sf):
    """Chunks of the second version, and whether each was kept from the first."""
    return E.rechunk(edited(spark, sf), "doc_id", 400)


@q("page_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS links, (len(html) - len(replace(html, chr(10), '')) + 1)::BIGINT AS lines, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS text_chars FROM pages")
def page_links(spark, sf):
    p = table(spark, sf, "pages", "page_id", "html")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"), (F.length("html") - F.length(F.regexp_replace("html", "\n", "")) + 1).cast("long").alias("lines"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"))


@q("style_sniff", "SELECT page_id, CASE WHEN contains(html, chr(9)) THEN 'tabs' ELSE 'spaces' END AS indent, contains(html, ';') AS semicolons, len(regexp_extract_all(html, '\"')) >= len(regexp_extract_all(html, '''')) AS double_quotes FROM pages")
def style_sniff(spark, sf):
    n = lambda c: F.regexp_count("html", F.lit(c))
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.when(F.col("html").contains("\t"), "tabs").otherwise("spaces").alias("indent"), F.col("html").contains(";").alias("semicolons"), (n('"') >= n("'")).alias("double_quotes"))


@q("language_stats", FILES + ", l(suffix, language) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGES.items()) + ") SELECT language, count(*) AS n_files, sum(size)::BIGINT AS total, round(avg(size), 6) AS mean_size FROM files JOIN l ON files.suffix = l.suffix GROUP BY 1")
def language_stats(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in T.LANGUAGES.items() for x in kv])
    return files(spark, sf).groupBy(F.element_at(m, F.col("suffix")).alias("language")).agg(F.count("*").alias("n_files"), F.sum("size").alias("total"), F.round(F.avg("size"), 6).alias("mean_size"))


@q("metadata_defaults", FILES + " SELECT f.doc_id, coalesce(l.quality, 0.5)::DOUBLE AS canon_weight, coalesce(l.toxic, 0) AS penalty FROM files f LEFT JOIN labels l ON f.doc_id = l.doc_id")
def metadata_defaults(spark, sf):
    return files(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("canon_weight"), F.coalesce("toxic", F.lit(0)).alias("penalty"))


@q("needs_backfill", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL ORDER BY d.doc_id LIMIT 100")
def needs_backfill(spark, sf):
    return table(spark, sf, "documents", "doc_id").join(table(spark, sf, "labels").where("quality is not null"), "doc_id", "left_anti").orderBy("doc_id").limit(100)


@q("path_primitives", FILES + " SELECT doc_id, string_split(path, '/')[1] AS module, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS item, list_reduce(list_slice(string_split(path, '/'), 1, 3), lambda a, b: a || '.' || b) AS qualified FROM files")
def path_primitives(spark, sf):
    p = F.split("path", "/")
    return files(spark, sf).select("doc_id", p[0].alias("module"), F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1).alias("item"), F.array_join(F.slice(p, 1, 3), ".").alias("qualified"))


@q("match_line_numbers", "SELECT doc_id, (length(left(text, instr(text, 'License') - 1)) - length(replace(left(text, instr(text, 'License') - 1), chr(10), '')) + 1)::BIGINT AS line FROM documents WHERE contains(text, 'License')")
def match_line_numbers(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").contains("License"))
    return d.select("doc_id", T.line_number(F.col("text"), F.instr("text", "License") - 1).cast("long").alias("line"))


@q("text_chunks")
def text_chunks(spark, sf):
    """Dispatcher over all files, and over modules (under negative ids) of a part eight times over: whole, by definition, by lines or by sentence."""
    from tessera.plans.code import sources

    one = sources(spark, sf).select((-F.col("k")).alias("doc_id"), F.array_join(F.array_repeat(F.concat("source", F.lit("\n\n")), 8), "\n").alias("text"), F.lit("py").alias("suffix"))
    # parts are few bytes and much work: they are dealt over tasks of a fixed number, else the tasks follow the bytes
    one = one.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return C.chunked(files(spark, sf).select("doc_id", "text", "suffix").unionByName(one), "doc_id", "suffix")


@q("fallback_embeddings")
def fallback_embeddings(spark, sf):
    """Unit vectors of all documents by the stand-in model."""
    return B.embedded(table(spark, sf, "documents", "doc_id", "text"), "doc_id")
