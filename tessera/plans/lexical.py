"""English stems, the text channel by them, and client names in texts; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stem as S
from tessera.operators import cases, curation, retrieval

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a function of (t, ) where t(name) reads a table, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name], ORACLE[name] = run, sql
        return f

    return add


def _case(column: str, suffix: str, table: dict[str, str], first: str, extra: dict[str, str]) -> str:
    """SQL of a step: the longest suffix, if it lies in the region and its own condition holds, is replaced."""
    cut = f"left({column}, length({column}) - length({suffix}))"
    rules = " ".join(f"WHEN '{k}' THEN " + (f"CASE WHEN {extra[k].format(cut)} THEN {cut} || '{v}' ELSE {column} END" if k in extra else f"{cut} || '{v}'") for k, v in table.items())
    return f"CASE WHEN {suffix} = '' OR length({column}) - length({suffix}) < {first} THEN {column} ELSE CASE {suffix} {rules} END END"


def _ends(column: str, suffixes) -> str:
    return f"regexp_extract({column}, '({'|'.join(suffixes)})$')"


REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
LI = {"ogi": "right({0}, 1) = 'l'", "li": "right({0}, 1) IN ('c', 'd', 'e', 'g', 'h', 'k', 'm', 'n', 'r', 't')"}
ION = {"ion": "right({0}, 1) IN ('s', 't')"}
#: The steps of the stemmer over words (lexeme), as SQL: stemmed (lexeme, stem).
STEMS = (
    "marked AS (SELECT lexeme, regexp_replace(regexp_replace(lexeme, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM words), "
    f"r1 AS (SELECT *, CASE WHEN regexp_matches(w, '^({'|'.join(S.BEGINNINGS)})') THEN length(regexp_extract(w, '^({'|'.join(S.BEGINNINGS)})')) WHEN regexp_matches(w, '^{REGION}') THEN length(regexp_extract(w, '^{REGION}')) ELSE length(w) END AS a FROM marked), "
    f"r2 AS (SELECT *, CASE WHEN regexp_matches(substring(w, a + 1), '^{REGION}') THEN a + length(regexp_extract(substring(w, a + 1), '^{REGION}')) ELSE length(w) END AS b FROM r1), "
    "s1 AS (SELECT lexeme, a, b, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM r2), "
    "p AS (SELECT *, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') AS x, left(w, length(w) - length(x)) AS v FROM s1), "
    f"s2 AS (SELECT lexeme, a, b, w IN ({', '.join(repr(x) for x in S.STAY)}) AS stay, w AS kept, CASE WHEN x LIKE 'eed%' THEN CASE WHEN length(v) >= a THEN v || 'ee' ELSE w END WHEN x = '' OR NOT regexp_matches(v, '[aeiouy]') THEN w WHEN regexp_matches(v, '(at|bl|iz)$') THEN v || 'e' WHEN regexp_matches(v, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(v, length(v) - 1) WHEN regexp_matches(v, '{SHORT}') AND a >= length(v) THEN v || 'e' ELSE v END AS w FROM p), "
    "s3 AS (SELECT * EXCLUDE (w), regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM s2), "
    f"s4 AS (SELECT * EXCLUDE (w), {_case('w', _ends('w', S.STEP2), S.STEP2, 'a', LI)} AS w FROM s3), "
    f"s5 AS (SELECT * EXCLUDE (w), {_case('w', _ends('w', S.STEP3), S.STEP3, 'a', {'ative': 'length({0}) >= b'})} AS w FROM s4), "
    f"s6 AS (SELECT * EXCLUDE (w), {_case('w', _ends('w', S.STEP4), dict.fromkeys(S.STEP4, ''), 'b', ION)} AS w FROM s5), "
    f"s7 AS (SELECT * EXCLUDE (w), CASE WHEN w LIKE '%e' AND (length(w) - 1 >= b OR length(w) - 1 >= a AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT}')) OR w LIKE '%ll' AND length(w) - 1 >= b THEN left(w, length(w) - 1) ELSE w END AS w FROM s6), "
    f"stemmed AS (SELECT lexeme, CASE WHEN length(lexeme) <= 2 THEN lexeme {' '.join(f'WHEN lexeme = {k!r} THEN {v!r}' for k, v in S.IRREGULAR.items())} WHEN stay THEN kept ELSE lower(w) END AS stem FROM s7) "
)
ENGLISH = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
LEX = f"list_filter(regexp_split_to_array(lower({{0}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '' AND w NOT IN ({ENGLISH}))"


@query("ret05_query_stems", f"WITH q AS (SELECT item_id, unnest({LEX.format('text')}) AS lexeme FROM benchmark), words AS (SELECT DISTINCT lexeme FROM q), {STEMS} SELECT DISTINCT item_id, stem FROM q JOIN stemmed USING (lexeme)")
def _(t):
    return retrieval.query_stems(t("benchmark"), "item_id", "text")


@query("ret05_stems", f"WITH words AS (SELECT DISTINCT unnest({LEX.format('text')}) AS lexeme FROM documents), {STEMS} SELECT lexeme, stem FROM stemmed")
def _(t):
    return S.stems(t("documents").select(F.explode(retrieval.lexemes(F.col("text"), S.STOP_WORDS)).alias("lexeme")))


@query(
    "ret06_stemmed_channel",
    f"WITH d AS (SELECT doc_id, source, unnest({LEX.format('text')}) AS lexeme FROM documents), q AS (SELECT item_id, unnest({LEX.format('text')}) AS lexeme FROM benchmark), words AS (SELECT lexeme FROM d UNION SELECT lexeme FROM q), {STEMS}, "
    "asked AS (SELECT DISTINCT item_id, stem FROM q JOIN stemmed USING (lexeme)), tf AS (SELECT doc_id, source, stem, count(*) AS tf FROM d JOIN stemmed USING (lexeme) GROUP BY ALL), "
    "h AS (SELECT item_id AS query_id, 'DOCUMENT' AS kind, doc_id, source AS bucket, 'fts' AS channel, CAST(sum(tf) AS DOUBLE) AS raw FROM tf JOIN asked USING (stem) GROUP BY ALL) "
    "SELECT query_id, kind, CAST(h.doc_id AS VARCHAR) AS id, bucket, channel, raw, left(text, 120) AS label FROM h JOIN documents USING (doc_id)",
)
def _(t):
    asked = retrieval.query_stems(t("benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    index = retrieval.stem_postings(t("documents"), "DOCUMENT", "doc_id", "text", "source", asked)
    labels = t("documents").select(F.lit("DOCUMENT").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("label"))
    return retrieval.with_labels(retrieval.by_stems(asked, index), labels)


SHAPE = "CASE WHEN trim(p) = '' THEN 'empty' WHEN ends_with(trim(p), ':') THEN 'ends in a colon' " + " ".join(f"WHEN contains(p, '{m}') THEN 'contains {m}'" for m in curation.SENTENCE_MARKS) + f" WHEN len({LEX.format('p')}) = 0 THEN 'stop words only' END"


@query("cur07_english_names", "WITH x AS (SELECT conv_id, turn, split_part(text, ' ', turn % 3 + 1) AS p FROM conversations UNION ALL SELECT conv_id, turn, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM conversations) SELECT conv_id, turn, p AS phrase, " + SHAPE + " AS reason FROM x")
def _(t):
    rows = t("conversations")
    one = rows.select("conv_id", "turn", F.expr("split_part(text, ' ', cast(turn % 3 + 1 as int))").alias("phrase"))
    two = rows.select("conv_id", "turn", F.expr("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)").alias("phrase"))
    return curation.name_shape(one.unionByName(two), stop_words=S.STOP_WORDS).select("conv_id", "turn", "phrase", "reason")


#: Practice summaries of which every third names its largest client, the documents, and the clients.
PRACTICE = (
    "WITH g AS (SELECT c_nationkey, c_mktsegment, o_orderpriority, count(*) AS n, max_by(c_name, c_acctbal) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), "
    "texts AS (SELECT 'cohort ' || c_nationkey || ' ' || c_mktsegment || ' ' || o_orderpriority AS k, 'Segment ' || c_mktsegment || ' of ' || n || CASE WHEN n % 3 = 0 THEN ': mostly ' || upper(top) || 's.' ELSE '' END AS t FROM g UNION ALL SELECT 'doc ' || doc_id, text FROM documents), "
    "clients AS (SELECT c_name AS display_name, ' Mail' || c_custkey % 40 || '.Example.COM ' AS external_ref FROM customer), "
    "p AS (SELECT DISTINCT 'NAME' AS kind, lower(trim(display_name)) AS phrase FROM clients UNION SELECT DISTINCT 'REFERENCE', lower(trim(external_ref)) FROM clients) "
)


def practice(t):
    tops = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max_by("c_name", "c_acctbal").alias("top"))
    named = F.when(F.col("n") % 3 == 0, F.concat(F.lit(": mostly "), F.upper("top"), F.lit("s."))).otherwise("")
    cohorts = tops.select(F.concat_ws(" ", F.lit("cohort"), "c_nationkey", "c_mktsegment", "o_orderpriority").alias("k"), F.concat(F.lit("Segment "), "c_mktsegment", F.lit(" of "), "n", named).alias("t"))
    texts = cohorts.unionByName(t("documents").select(F.concat(F.lit("doc "), "doc_id").alias("k"), F.col("text").alias("t")))
    clients = t("customer").select(F.col("c_name").alias("display_name"), F.concat(F.lit(" Mail"), F.col("c_custkey") % 40, F.lit(".Example.COM ")).alias("external_ref"))
    return texts, clients


@query("pra06_client_names", PRACTICE + "SELECT k, kind, phrase FROM texts JOIN p ON contains(lower(t), phrase)")
def _(t):
    texts, clients = practice(t)
    return cases.scan_clients(texts, "k", "t", clients)


@query(
    "pra06_refused",
    PRACTICE + r", hit AS (SELECT k, bool_or(kind = 'NAME') AS has_name, bool_or(kind = 'REFERENCE') AS has_reference FROM texts JOIN p ON contains(lower(t), phrase) GROUP BY 1), "
    r"f AS (SELECT k, coalesce(regexp_matches(t, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}'), false) AS has_uuid, coalesce(regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), false) AS has_email, coalesce(regexp_matches(t, '\+?[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}'), false) AS has_phone FROM texts) "
    "SELECT k, has_uuid, has_email, has_phone, coalesce(has_name, false) AS has_name, coalesce(has_reference, false) AS has_reference FROM f LEFT JOIN hit USING (k) WHERE has_uuid OR has_email OR has_phone OR has_name OR has_reference",
)
def _(t):
    texts, clients = practice(t)
    return cases.scan_identifiers(texts, "k", "t", clients)
