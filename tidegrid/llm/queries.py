"""The queries opN_<name> over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, hnsw, licenses, linededup, minhash, mixing, pii, quotes, toxicity, winnow
from tidegrid.llm._store import settle, table, texts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _canonical_sql(text: str) -> str:
    """licenses.canonical_lines() for DuckDB."""
    prose = rf"regexp_replace(lower({text}), '(?m)^([^\p{{L}}\p{{N}}\n]*copyright)([ \t](?:{licenses.PROSE}))', '\1-\2', 'g')"  # there is no look-ahead
    out = rf"regexp_replace({prose}, '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t]|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
    out = rf"' ' || replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for best, *others in licenses.SPELLINGS:  # twice for neighbours, as there is no look-ahead
        for _ in range(2):
            out = f"regexp_replace({out}, ' (?:{'|'.join(others)}) ', ' {best} ', 'g')"
    return out


def _whole_sql(lines: str) -> str:
    return f"sha256(trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g')))"


SQL_OP2 = f"""
WITH registry AS (SELECT * FROM (VALUES {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licenses.REGISTRY)}) r(license, text)),
known AS (SELECT digest, min(license) AS license FROM (SELECT {_whole_sql(_canonical_sql("text"))} AS digest, license FROM registry) GROUP BY digest),
d AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT doc_id, {_whole_sql("lines")} AS digest FROM d),
l AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, {_whole_sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d)) JOIN known USING (digest)),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM l GROUP BY doc_id)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


DOMAINS = ("web", "books", "forum", "reference")
MIX_WEIGHTS = {
    "domain": {"web": 40, "books": 30, "forum": 20, "reference": 10},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
}


def source_domain() -> Column:
    """The domain of a source named src<number>: by the number's remainder by four; other sources are in the domain other."""
    number = F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), (number % 4).cast("int")), F.lit("other"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = settle(mixing.weigh(table(spark, sf_dir, "documents"), source_domain()), "weighed")
    return mixing.mix(weighed, weights=MIX_WEIGHTS)


def _level_sql(level: str, parents: list[str]) -> str:
    """One level of the budget's way down: a table s_<level> from the leaves and the parent's table."""
    cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    names = ", ".join([*parents, level])
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    total = f"JOIN (SELECT {', '.join(parents)}, share AS total FROM s_{parents[-1]}) p USING ({', '.join(parents)})" if parents else ", budget"
    return f"""
c_{level} AS (SELECT *, {weight} AS w FROM (SELECT {names}, sum(tokens) * 4 AS cap FROM leaf GROUP BY ALL) {total}),
f_{level} AS (SELECT *, cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_
  FROM c_{level} WINDOW o AS ({by} ORDER BY cap / w, {level})),
l_{level} AS (SELECT *, total - coalesce(sum(cap) FILTER (full_) OVER ({by}), 0) AS left_, CASE WHEN full_ THEN 0 ELSE w END AS part FROM f_{level}),
r_{level} AS (SELECT *, sum(part) OVER ({by} ORDER BY cap / w, {level} ROWS UNBOUNDED PRECEDING) AS run, sum(part) OVER ({by}) AS all_w FROM l_{level}),
s_{level} AS (SELECT {names}, CAST(CASE WHEN full_ THEN cap ELSE (left_ * run) // all_w - (left_ * (run - part)) // all_w END AS BIGINT) AS share FROM r_{level}),"""


SQL_OP4 = (
    r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN regexp_full_match(source, 'src[0-9]{1,9}') THEN ['web', 'books', 'forum', 'reference'][CAST(substr(source, 4) AS BIGINT) % 4 + 1] ELSE 'other' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
budget AS (SELECT sum(tokens) AS total FROM leaf),"""
    + _level_sql("domain", [])
    + _level_sql("lang", ["domain"])
    + _level_sql("source", ["domain", "lang"])
    + """
g AS (SELECT domain, lang, source, share // greatest(tokens, 1) AS epochs, share % greatest(tokens, 1) AS rest FROM leaf JOIN s_source USING (domain, lang, source)),
m AS (SELECT *, md5('0:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM d JOIN g USING (domain, lang, source)),
q AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY turn, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM m)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND ahead + n_tokens <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(CASE WHEN ahead + n_tokens <= rest THEN 0 ELSE greatest(rest - ahead, 0) END AS BIGINT) AS cut_tokens FROM q
"""
)


def op5_pii(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """key: the secret of the pseudonyms, by default that in spark.tidegrid.pii.key; without either a public one that is for tests only, with a warning."""
    key = key or spark.conf.get("spark.tidegrid.pii.key", None)
    if not key:
        warnings.warn("no secret key: these pseudonyms can be undone by anyone", stacklevel=2)
        key = "tidegrid"
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def vocabulary() -> str:
    """The vocabulary file of the installed public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, path or vocabulary())
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


SQL_OP8 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS raw FROM conversations),
l AS (SELECT id, conv_id, turn, role, i, raw[i] AS line, length(replace(replace(regexp_extract(raw[i], '^((?:[ \t]*>)*)', 1), ' ', ''), chr(9), '')) AS level,
        coalesce(raw[i + 1], '') AS ahead FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM m)),
k AS (SELECT *, level = 0 AND regexp_matches(lower(line), '^[ \t]*(?:on|am|le|el) .{1,200}(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$') AND regexp_matches(ahead, '^[ \t]*>') AS attribution,
        trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)*)', '')), '[ \t]+', ' ', 'g')) AS key FROM l),
t AS (SELECT conv_id, turn, role, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT attribution), '') AS said FROM k GROUP BY id, conv_id, turn, role),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM k WHERE key <> '' AND NOT attribution),
u AS (SELECT conv_id, turn, level, FALSE AS whole, key, 1 AS n FROM g
      UNION ALL SELECT conv_id, turn, level, TRUE, string_agg(key, chr(10) ORDER BY i), count(*) FROM g GROUP BY id, conv_id, turn, level, run),
q AS (SELECT conv_id, turn, level, whole, key, sum(n) AS n FROM u WHERE level > 0 GROUP BY ALL),
s AS (SELECT DISTINCT conv_id, turn, whole, key FROM u WHERE level = 0),
v AS (SELECT q.conv_id, q.turn, q.level, q.whole, q.key, any_value(q.n) AS n, max(s.turn) AS parent FROM q JOIN s ON q.conv_id = s.conv_id AND q.whole = s.whole AND q.key = s.key AND s.turn < q.turn GROUP BY ALL),
p AS (SELECT conv_id, turn, max({'l': -level, 'w': w, 'n': n, 'parent': parent}).parent AS parent
      FROM (SELECT conv_id, turn, level, parent, sum(CASE WHEN whole THEN n ELSE 0 END) AS w, sum(CASE WHEN whole THEN 0 ELSE n END) AS n FROM v GROUP BY ALL) GROUP BY ALL),
r AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM p UNION ALL SELECT r.conv_id, r.turn, p.parent, depth + 1 FROM r JOIN p ON r.conv_id = p.conv_id AND r.root = p.turn),
z AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM r GROUP BY ALL)
SELECT t.conv_id, coalesce(z.root, t.turn) AS root, t.turn, t.role, p.parent, CAST(coalesce(z.depth, 0) AS BIGINT) AS depth,
  CASE WHEN t.conv_id IS NULL OR t.turn IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY t.conv_id, coalesce(z.root, t.turn) ORDER BY t.turn) - 1 END AS position, t.said
FROM t LEFT JOIN p USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn)
"""


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    paired = winnow.follow(winnow.winnowed(winnow.deal(docs), "text", "prints"), ["text", "prints"])
    n = F.length("text")
    swapped = F.floor(n / 4).cast("int")
    start = F.substring("text", F.lit(1), n - swapped)
    rest = F.coalesce(F.substring("next_text", F.lit(1), swapped), F.lit(""))
    paired = paired.withColumns({"n_chars": n.cast("long"), "edited": F.concat(start, rest)})
    both = winnow.winnowed(paired, "edited", "edited_prints")
    for a in ("prints", "edited_prints", "next_prints"):
        both = both.withColumn(f"{a}_hashes", winnow.hashes(a))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.rendered("prints").alias("fingerprint"), winnow.rendered("edited_prints").alias("edited_fingerprint"),
        winnow.likeness("prints_hashes", "edited_prints_hashes").alias("near_edited"),
        winnow.likeness("prints_hashes", "next_prints_hashes").alias("near_next"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, s.i, list_extract(string_split(text, chr(10)), s.i) AS line
      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d) s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_hnsw": op7_hnsw,
    "op8_quotes": op8_quotes,
    "op9_winnow": op9_winnow,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": SQL_OP2,
    "op4_mixing": SQL_OP4,
    "op8_quotes": SQL_OP8,
    "op10_line_dedup": SQL_OP10,
}
