"""A raw text cut into pieces by the evidence that covers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extraction import given_once


def in_characters(texts: DataFrame) -> DataFrame:
    """Keyword offsets in characters instead of UTF-16 units, of which some characters take two."""
    wide = F.expr(r"if(raw_text rlike '[\\x{10000}-\\x{10FFFF}]', filter(sequence(0, length(raw_text) - 1), i -> ascii(substring(raw_text, i + 1, 1)) > 65535), cast(array() as array<int>))")
    at = "x.{0} - size(filter(wide, (a, j) -> a + j < x.{0}))"
    moved = f"transform(keywords, x -> named_struct('role', x.role, 'char_start', {at.format('char_start')}, 'char_end', {at.format('char_end')}))"
    return texts.withColumn("wide", wide).withColumn("keywords", F.expr(moved)).drop("wide")


def segments(texts: DataFrame) -> DataFrame:
    """texts: id, raw_text, keywords (role, char_start, char_end in UTF-16 units). Pieces (id, begin,
    end, text, roles) that together are the text, counted in characters; ranges outside it or without
    extent are dropped, and neighbours with equal roles are one piece."""
    n = F.length("raw_text")
    texts = in_characters(texts)
    valid = F.filter("keywords", lambda k: (k["char_start"] >= 0) & (k["char_end"] > k["char_start"]) & (k["char_end"] <= n))
    rows = texts.where(n > 0).select("id", "raw_text", valid.alias("k"))
    # within the text's row: no piece is shuffled to meet its neighbour. Every range ends at a cut, so what covers
    # a piece's beginning covers all of it
    cuts = "array_sort(array_distinct(concat(array(0), transform(k, x -> x.char_start), filter(transform(k, x -> x.char_end), e -> e < length(raw_text)))))"
    roles = "array_sort(array_distinct(transform(filter(k, x -> x.char_start <= b and x.char_end > b), x -> x.role)))"
    fresh = given_once({"p": f"transform({cuts}, b -> named_struct('begin', b, 'roles', {roles}))"}, "filter(w.p, (x, i) -> i = 0 or w.p[i - 1].roles != x.roles)")
    merged = given_once({"f": fresh}, "transform(v.f, (x, i) -> named_struct('begin', x.begin, 'end', if(i + 1 < size(v.f), v.f[i + 1].begin, length(raw_text)), 'roles', x.roles))", "v")
    each = rows.select("id", "raw_text", F.expr(merged).alias("pieces")).select("id", "raw_text", F.explode_outer("pieces").alias("p"))
    return each.select("id", "p.begin", "p.end", F.expr("substring(raw_text, p.begin + 1, p.end - p.begin)").alias("text"), "p.roles")
