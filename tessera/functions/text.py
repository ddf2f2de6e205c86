"""Column functions on text: phrase normalisation, keys, trigrams, cleaning, guards. All are Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of URL parameters whose values are secrets, and the entities that are decoded.
SECRET_PARAMETERS = ("token", "key", "api_key", "apikey", "access_token", "secret", "password", "auth", "signature", "sig")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def norm_phrase(c) -> Column:
    """Lower case; other characters than a-z 0-9 % + / - become blanks; blanks collapse."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9%+/\-]+", " "))


def canonical_key(c) -> Column:
    """Upper-case key of up to 80 characters, or null if no valid one can be made."""
    key = F.upper(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    key = F.substring(F.regexp_replace(key, r"^[^A-Z]+", ""), 1, 80)
    return F.when(key.rlike(r"^[A-Z][A-Z0-9_]{2,79}$"), key)


def key_for(c) -> Column:
    return F.coalesce(canonical_key(c), F.concat(F.lit("PHRASE_"), F.upper(F.substring(F.sha2(c, 256), 1, 12))))


def disambiguate(key, term) -> Column:
    """A key of up to 80 characters that ends in six digits of the term's hash."""
    return F.concat(F.substring(key, 1, 73), F.lit("_"), F.upper(F.substring(F.sha2(term, 256), 1, 6)))


def trigrams(c) -> Column:
    """Distinct trigrams of the words [0-9A-Za-z]+, each with two blanks before it and one after it."""
    words = F.filter(F.split(F.lower(c), r"[^0-9a-z]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trgm_similarity(a, b) -> Column:
    """Jaccard similarity of two trigram sets (columns of trigrams()); 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def estimate_tokens(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def redact_url(c) -> Column:
    """A URL with the values of secret parameters replaced; names are compared as decoded, other parameters stay as written.

    Parameters are what follows the first ? or & and each & after it; a value ends at a #.
    """

    def one(p):
        name = F.substring_index(p, "=", 1)
        secret = F.lower(F.coalesce(F.try_url_decode(name), name)).isin(*SECRET_PARAMETERS)
        return F.when(secret, F.regexp_replace(p, "=[^#]+", "=REDACTED")).otherwise(p)

    head = F.regexp_extract(c, r"^([^?&]*[?&])", 1)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    return F.when(head == "", c).otherwise(F.concat(head, F.array_join(F.transform(F.split(rest, "&"), one), "&")))


def html_to_text(c) -> Column:
    """Text of a page for ingestion: scripts and styles go, block ends become blank lines, six entities are decoded."""
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|li|tr|section|article)>", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


# What is done to a page's markup, one after the other, before its entities are decoded.
MARKUP_STEPS = (
    (r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "),
    (r"(?i)</(?:div|h[1-6]|li|p|section|tr)>", "\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", ""),
)


def page_text(c) -> Column:
    """Text of a page as it is landed: scripts and styles become a blank, block ends a blank line, br a line end; line ends are \n, nothing is trimmed or collapsed."""
    out = reduce(lambda text, step: F.regexp_replace(text, *step), MARKUP_STEPS, c)
    out = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, out)
    return F.regexp_replace(out, r"\r\n?", "\n")


def video_id(c) -> Column:
    """The 11-character id of a bare id or of any form of a video address."""
    bare = F.when(c.rlike(r"^[A-Za-z0-9_-]{11}$"), c)
    found = F.regexp_extract(c, r"(?:youtu\.be/|[?&]v=|/(?:shorts|embed|live|v)/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.coalesce(bare, F.nullif(found, F.lit("")))


def canonical_video_url(c) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(c))


def is_embeddable(c) -> Column:
    """Text, not media: no data address, no magic bytes of a file, not blank."""
    head = F.substring(c, 1, 200)
    media = head.rlike(r"(?i)^\s*data:[a-z]+/") | head.rlike(r"^(?:%PDF-|\x89PNG|GIF8[79]a|ID3|OggS|RIFF)") | head.rlike(r"(?i)^(?:image|audio|video)/[a-z0-9.+-]+$")
    return F.coalesce((F.btrim(c) != "") & ~media, F.lit(False))


def strict_number(c) -> Column:
    """A double from plain decimal notation only; anything else is null."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.cast("double"))


def strict_date(c) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def adherence_band(c) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c >= 80, "HIGH").when(c >= 50, "PARTIAL").otherwise("LOW")


def map_total(c) -> Column:
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
