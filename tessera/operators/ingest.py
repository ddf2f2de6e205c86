"""Ingestion: identity, versions, sections, chunks, captions, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sizes of chunks and blocks in characters.
TARGET, MIN_TAIL, BLOCK = 2400, 400, 1200
#: The blanks that are trimmed off a paragraph: all of Unicode's space separators.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def segment_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sec_no, location, body): a row for each non-empty section; location is the stack of open headings.

    One fold over the lines keeps the stack and the open body. Text before a heading is at (body); a document
    without any non-empty section gives one (body) row of its text.
    """
    kind = "struct<stack:array<string>,body:string,out:array<struct<location:string,body:string>>>"

    def close(a):
        where = F.when(F.size(a["stack"]) > 0, F.array_join(F.filter(a["stack"], lambda h: h != ""), " > ")).otherwise("(body)")
        text = F.btrim(a["body"], F.lit(" \n\t\r"))
        return F.when(text == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(where.alias("location"), text.alias("body")))))

    def step(a, line):
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
        title = F.btrim(F.regexp_replace(line, r"^#{1,6}\s+|\s*#*\s*$", ""))
        padded = F.concat(F.slice(a["stack"], F.lit(1), level - 1), F.array_repeat(F.lit(""), F.greatest(F.lit(0), level - 1 - F.size(a["stack"]))), F.array(title))
        opened = F.struct(padded.alias("stack"), F.lit("").alias("body"), close(a).alias("out"))
        longer = F.struct(a["stack"].alias("stack"), F.concat(a["body"], line, F.lit("\n")).alias("body"), a["out"].alias("out"))
        return F.when(level > 0, opened).otherwise(longer)

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("body"), F.array().cast("array<struct<location:string,body:string>>").alias("out")).cast(kind)
    found = F.aggregate(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), start, step, close)
    whole = F.array(F.struct(F.lit("(body)").alias("location"), F.coalesce(F.col(text_col), F.lit("")).alias("body")))
    rows = df.select(F.col(id_col), F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("sec_no", "s"))
    return rows.select(id_col, "sec_no", "s.location", "s.body")


def chunks(text, target: int = TARGET, min_tail: int = MIN_TAIL):
    """Column: paragraphs packed greedily to target characters; a short tail joins the chunk before it."""
    # a lambda of one argument: transform would pass btrim a paragraph's place as the characters to trim
    paragraphs = F.filter(F.transform(F.split(text, r"\n[\t\n\f\r ]*\n"), lambda p: F.btrim(p, F.lit(BLANKS))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("size"))

    def step(a, p):
        full = (a["size"] > 0) & (a["size"] + F.length(p) > target)
        flushed = F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), p.alias("cur"), (F.length(p) + 2).alias("size"))
        longer = F.struct(a["out"].alias("out"), F.when(a["size"] > 0, F.concat(a["cur"], F.lit("\n\n"), p)).otherwise(p).alias("cur"), (a["size"] + F.length(p) + 2).alias("size"))
        return F.when(full, flushed).otherwise(longer)

    def finish(a):
        n = F.size(a["out"])
        fold = (n > 0) & (F.length(a["cur"]) < min_tail)
        folded = F.concat(F.slice(a["out"], F.lit(1), n - 1), F.array(F.concat(F.try_element_at(a["out"], n), F.lit("\n\n"), a["cur"])))
        return F.when(a["size"] == 0, a["out"]).when(fold, folded).otherwise(F.concat(a["out"], F.array(a["cur"])))

    return F.aggregate(paragraphs, start, step, finish)


def chunk_sections(df: DataFrame, text_col: str = "body", target: int = TARGET, min_tail: int = MIN_TAIL) -> DataFrame:
    cols = [c for c in df.columns if c != text_col]
    return df.select(*cols, F.posexplode(chunks(F.col(text_col), target, min_tail)).alias("chunk_index", "chunk"))


def dedup_by_hash(df: DataFrame, id_col: str, hash_col: str, order: str) -> DataFrame:
    """df with duplicate_of and status: the first row of a hash is canonical.

    The first of each hash is a partial aggregation, so a hash of many rows is no window.
    """
    first = df.groupBy(hash_col).agg(F.min_by(F.col(id_col), F.struct(order, id_col)).alias("_first"))
    out = df.join(first, hash_col, "left")
    out = out.withColumn("duplicate_of", F.when(F.col(id_col) != F.col("_first"), F.col("_first"))).drop("_first")
    return out.withColumn("status", F.when(F.col("duplicate_of").isNotNull(), "DEDUPED").otherwise("NORMALIZED"))


def version_by_url(df: DataFrame, url: str, order: list[str], sha: str | None = None) -> DataFrame:
    """source_version counts the sightings of a url; with sha only those whose content changed."""
    w = W.partitionBy(url).orderBy(*order)
    if sha:
        changed = (~F.col(sha).eqNullSafe(F.lag(sha).over(w)) | (F.row_number().over(w) == 1)).cast("int")
        return df.withColumn("_new", changed).withColumn("source_version", F.sum("_new").over(w)).drop("_new")
    return df.withColumn("source_version", F.row_number().over(w))


def resolve_kind(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """The declared kind if it is registered and active, else OTHER. kinds is a bounded registry."""
    active = kinds.filter("active").select(F.col("kind").alias("declared_kind"), F.lit(True).alias("_known"))
    return df.join(F.broadcast(active), "declared_kind", "left").withColumn("kind", F.when(F.col("_known"), F.col("declared_kind")).otherwise("OTHER")).drop("_known")


def normalise_rights(df: DataFrame, known: tuple[str, ...] = ("PUBLIC", "LICENSED", "PRIVATE")) -> DataFrame:
    ok = F.coalesce(F.col("rights").isin(*known), F.lit(False))
    out = df.withColumn("rights_note", F.when(~ok, F.concat(F.lit("unknown rights "), F.coalesce("rights", F.lit("null")), F.lit(" read as PUBLIC"))))
    out = out.withColumn("rights", F.when(ok, F.col("rights")).otherwise("PUBLIC"))
    return out.withColumn("excerpt_only", F.col("rights") != "PUBLIC")


def filter_unknown(new: DataFrame, items: DataFrame, id_col: str, identifiers: dict[str, str]) -> DataFrame:
    """Rows of new none of whose identifiers is known. identifiers: type -> expression; one equi-join, no OR."""

    def exploded(df, *cols):
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("value")) for k, e in identifiers.items()])
        return df.select(*cols, F.inline(pairs)).filter("value is not null")

    known = exploded(new, id_col).join(exploded(items).distinct(), ["kind", "value"], "left_semi").select(id_col).distinct()
    return new.join(known, id_col, "left_anti")


def entries_since_cursor(entries: DataFrame, cursors: DataFrame) -> DataFrame:
    """Entries of a feed before its last-seen guid, in feed order; all of them if it isn't there."""
    joined = entries.join(cursors, "source", "left")
    stop = joined.filter(F.col("guid") == F.col("cursor")).groupBy("source").agg(F.min("pos").alias("_stop"))
    return joined.join(stop, "source", "left").filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_stop", "cursor")


def search_hash(c):
    return F.sha2(F.lower(F.btrim(F.regexp_replace(c, r"\s+", " "))), 256)


def suppress_recent(searches: DataFrame, history: DataFrame, adapters: DataFrame) -> DataFrame:
    """Searches without an equal one within their adapter's repeat_after_hours; 0 hours suppress nothing."""
    last = history.select("adapter", search_hash(F.col("query")).alias("h"), F.col("executed_at").alias("then"))
    now = searches.join(F.broadcast(adapters.select("adapter", "repeat_after_hours")), "adapter").withColumn("h", search_hash(F.col("query")))
    near = F.col("then") >= F.col("at") - F.make_dt_interval(hours=F.col("repeat_after_hours"))
    cond = (now.adapter == last.adapter) & (now.h == last.h) & near & (F.col("then") <= F.col("at")) & (F.col("repeat_after_hours") > 0)
    return now.join(last, cond, "left_anti").drop("h", "repeat_after_hours")


def dedupe_segments(df: DataFrame, id_col: str, pos: str) -> DataFrame:
    """Captions without the words that repeat the end of the caption before, where the two overlap in time."""
    w = W.partitionBy(id_col).orderBy(pos)
    plain = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), lambda x: F.lit(True))
    out = df.withColumn("_words", F.filter(F.split(F.btrim("text"), r"\s+"), lambda x: x != "")).withColumn("_plain", plain)
    out = out.withColumn("_prev", F.lag("_plain").over(w)).withColumn("_end", F.last("end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    n = F.least(F.size("_prev"), F.size("_plain"))
    fits = F.when(n > 0, F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice("_prev", -k, k) == F.slice("_plain", F.lit(1), k))))
    overlap = F.coalesce(F.col("start") < F.col("_end") - 0.01, F.lit(False))
    out = out.withColumn("time_overlap", overlap).withColumn("dropped_words", F.when(overlap, F.coalesce(fits, F.lit(0))).otherwise(0))
    kept = F.array_join(F.slice("_words", F.col("dropped_words") + 1, F.greatest(F.size("_words") - F.col("dropped_words"), F.lit(0))), " ")
    return out.withColumn("text", kept).drop("_words", "_plain", "_prev", "_end")


def pack_blocks(df: DataFrame, id_col: str, limit: int = BLOCK) -> DataFrame:
    """(id, block_no, start, text): segments packed greedily to limit characters; a document's segments are one array."""
    rows = df.filter(F.btrim("text") != "").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("segs"))
    kind = "struct<out:array<struct<start:double,text:string>>,start:double,cur:string>"
    init = F.struct(F.array().cast("array<struct<start:double,text:string>>").alias("out"), F.lit(None).cast("double").alias("start"), F.lit("").alias("cur")).cast(kind)

    def step(a, s):
        full = (a["cur"] != "") & (F.length(a["cur"]) + 1 + F.length(s["text"]) > limit)
        done = F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["cur"].alias("text"))))
        fresh = F.struct(F.when(full, done).otherwise(a["out"]).alias("out"), s["start"].cast("double").alias("start"), s["text"].alias("cur"))
        more = F.struct(a["out"].alias("out"), a["start"].alias("start"), F.concat(a["cur"], F.lit(" "), s["text"]).alias("cur"))
        return F.when(full | (a["cur"] == ""), fresh).otherwise(more)

    end = lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["cur"].alias("text")))))
    blocks = rows.select(id_col, F.posexplode(F.aggregate("segs", init, step, end)).alias("block_no", "b"))
    return blocks.select(id_col, "block_no", "b.start", "b.text")


def asr_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("auto_generated", F.when(F.size("segments") > 0, F.col("isAutoGenerated")))


def ingestion_status(envelopes: DataFrame, kinds: DataFrame, deltas: DataFrame) -> DataFrame:
    latest = deltas.groupBy("envelope_id").agg(F.max_by("delta_class", "analysis_seq").alias("latest_delta"))
    return envelopes.join(F.broadcast(kinds.select("kind", "label")), "kind", "left").join(latest, "envelope_id", "left")


def client_safe_sources(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter((F.col("rights") == "PUBLIC") & F.col("duplicate_of").isNull())


def discovery_state(adapters: DataFrame, queries: DataFrame, fetches: DataFrame) -> DataFrame:
    """Per active adapter; searches and fetches are counted apart, so neither multiplies the other."""
    q = queries.groupBy("adapter").agg(F.count(F.lit(1)).alias("searches"), F.sum("items_new").alias("items_new"), F.max("at").alias("q_at"))
    f = fetches.groupBy("adapter").agg(F.count_if(F.col("outcome") == "FETCHED").alias("fetched"), F.count_if(F.col("outcome") != "FETCHED").alias("refused"), F.max("at").alias("f_at"))
    out = adapters.filter("active").select("adapter").join(q, "adapter", "left").join(f, "adapter", "left")
    return out.withColumn("last_activity", F.greatest("q_at", "f_at")).drop("q_at", "f_at").fillna(0, ["searches", "items_new", "fetched", "refused"])


def sources_due(sources: DataFrame) -> DataFrame:
    return sources.filter("active and monitored").orderBy(F.col("last_checked").asc_nulls_first(), "source")


def upsert_creators(videos: DataFrame) -> DataFrame:
    rows = videos.filter("platform_id is not null and namespace is not null")
    return rows.groupBy("namespace", "platform_id").agg(F.max_by("name", F.struct("seen_at", "name")).alias("name"))
