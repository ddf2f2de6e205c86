"""Files as DataFrames: rate cards, inboxes, transcripts, feeds, search results, documents and answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_price_registry(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, modality, in_rate, out_rate) of a JSON rate card; a flat model is TEXT, names with _ first are notes."""
    rate = "input_usd_per_mtok:double,output_usd_per_mtok:double"
    kind = f"struct<prices:map<string,struct<{rate},modalities:map<string,struct<{rate}>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["prices"]).alias("model_name", "m")).filter("not startswith(model_name, '_')")
    flat = F.create_map(F.lit("TEXT"), F.struct("m.input_usd_per_mtok", "m.output_usd_per_mtok"))
    rows = rows.select("model_name", F.explode(F.coalesce("m.modalities", flat)).alias("modality", "r")).filter("not startswith(modality, '_')")
    return rows.select("model_name", F.upper("modality").alias("modality"), F.col("r.input_usd_per_mtok").alias("in_rate"), F.col("r.output_usd_per_mtok").alias("out_rate"))


def scan_inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, suffix, content, meta, note): landed files; an unreadable sidecar is a note, not a failure. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    side = files.filter(F.col("path").endswith(".meta.json"))
    meta = F.from_json(F.col("content").cast("string"), "map<string,string>")
    side = side.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), meta.alias("meta"), F.lit(True).alias("_s"))
    out = files.filter(~F.col("path").endswith(".meta.json")).join(side, "path", "left")
    note = F.when(F.col("_s") & F.col("meta").isNull(), "unreadable sidecar")
    return out.select("path", F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content", "meta", note.alias("note"))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(videos, segments) of nested JSON; a video is OK, NO_TRANSCRIPT or ERROR."""
    kind = "url string, title string, error string, transcript array<struct<text:string,start:double,duration:double>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    some = F.coalesce(F.size("transcript"), F.lit(0)) > 0
    outcome = F.when(F.col("error").isNotNull(), "ERROR").when(some, "OK").otherwise("NO_TRANSCRIPT")
    parts = raw.filter(some).select("url", F.posexplode("transcript").alias("pos", "s"))
    return raw.select("url", "title", outcome.alias("outcome"), "error"), parts.select("url", "pos", "s.text", "s.start", "s.duration")


def feed_entries(pages: DataFrame, xml_col: str = "body") -> DataFrame:
    """Entries of RSS 2.0 and Atom texts in one shape; a guid that is missing is the link.

    A summary that is missing is the full content; only RSS entries have a transcript.
    """
    link = "array<struct<_href:string,_VALUE:string>>"
    item = "struct<title:string,link:string,guid:string,pubDate:string,description:string,encoded:string,transcript:string,enclosure:struct<_url:string>>"
    entry = f"struct<title:string,link:{link},id:string,published:string,updated:string,summary:string,content:string>"
    opts = {"ignoreNamespace": "true"}
    rss = pages.withColumn("_x", F.explode(F.from_xml(xml_col, f"struct<channel:struct<item:array<{item}>>>", opts)["channel"]["item"])).drop(xml_col)
    atom = pages.withColumn("_x", F.explode(F.from_xml(xml_col, f"struct<entry:array<{entry}>>", opts)["entry"])).drop(xml_col)

    def said(c):
        return F.nullif(F.btrim(c), F.lit(""))

    def told(df, url, guid, published, summary, media, transcript):
        title = F.coalesce(F.nullif(F.btrim("_x.title"), F.lit("")), F.lit("(untitled)"))
        cols = {"title": title, "url": url, "guid": F.coalesce(guid, url), "published": published, "summary": summary, "media": media, "transcript": transcript}
        return df.withColumns(cols).drop("_x")

    x = F.col
    first = told(rss, x("_x.link"), x("_x.guid"), x("_x.pubDate"), F.coalesce(said("_x.description"), "_x.encoded"), x("_x.enclosure._url"), said("_x.transcript"))
    second = told(atom, x("_x.link")[0]["_href"], x("_x.id"), F.coalesce("_x.published", "_x.updated"), F.coalesce(said("_x.summary"), "_x.content"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return first.unionByName(second)


def search_results(rows: DataFrame, json_col: str = "payload") -> DataFrame:
    """One row per found id; a payload that isn't read is one row with outcome MALFORMED."""
    ids = F.from_json(json_col, "struct<esearchresult:struct<idlist:array<string>>>")["esearchresult"]["idlist"]
    out = rows.withColumn("_ids", ids).withColumn("outcome", F.when(F.col("_ids").isNull(), "MALFORMED").otherwise("OK"))
    return out.select(*[c for c in rows.columns if c != json_col], "outcome", F.explode_outer("_ids").alias("external_id"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole documents, so that offsets are absolute."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """Labelled phrases with what they should, mustn't and may resolve to."""
    kind = "phrase string, expected string, to array<string>, must_not array<string>, tolerable array<string>"
    return spark.read.schema(f"phrases array<struct<{', '.join(k.replace(' ', ':', 1) for k in kind.split(', '))}>>").json(path, multiLine=True).select(F.inline("phrases"))
