"""Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Words: letters, marks, digits and underscores of any script.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def strip(x: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def token_estimate(x: Column) -> Column:
    """A quarter of the code points, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(x) / 4)).cast("int")


def slug(x: Column) -> Column:
    """Lower case; runs of other characters than letters a-z, German ones and digits become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9äöüß]+", "-"), "^-+|-+$", "")


def stem(name: Column) -> Column:
    """A file name without folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_SPACE)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(document_id: Column, version: Column, sequence: Column) -> Column:
    """The id of a chunk of a version of a document: the same at each ingest."""
    return uuid5_url(F.concat(F.lit("rag://"), document_id, F.lit("/v"), version.cast("string"), F.lit("/"), sequence.cast("string")))


def tokens(x: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), F.lit(1))


def bucket(token: Column, size: int) -> Column:
    """A bucket of a word: the first 32 bits of its md5, modulo ``size``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % size).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.lit(1), F.size(q))


def rrf_score(ranks: Column, k: int) -> Column:
    """Sum of ``1 / (k + rank + 1)`` over (list number, rank) pairs, in list order whatever the order of rows."""
    return F.aggregate(F.array_sort(ranks), F.lit(0.0), lambda s, x: s + 1.0 / (x["rank"] + F.lit(k + 1)))


def sparse_from_weights(weights: Column) -> Column:
    """Indices and values of a map of term ids to weights, by id, without weights of zero or less."""
    entries = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] > 0))
    return F.struct(F.transform(entries, lambda e: e["key"].cast("long")).alias("indices"), F.transform(entries, lambda e: e["value"].cast("double")).alias("values"))


def markdown_table(rows: Column) -> Column:
    """A Markdown table of an array of arrays of strings: empty rows dropped, under two rows an empty text, short rows padded."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))))
    clean = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), line)
    return F.when(F.size(clean) < 2, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(clean[0]), rule), body), "\n"))
