"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke 2008). DataFrame operations only.

A signature is a common word (the anchor) with the next two content words after it; a document's fingerprint is the set
of its signatures, as sorted 32-bit hashes of 8 hex digits each. Two sets are compared by Jaccard similarity; sets of
one length class and its neighbours are compared only where their lengths let them reach the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ne ou par pas plus pour qui que sa se ses son sur un une "
    "aber als auch auf aus bei das dem den der des die ein eine einen einer es im ist mit nach nicht sich sie sind so und von war wie zu zum zur "
    "al como con del el ella era esta fue las lo los me mi muy no nos para pero por si sin su sus te y ya yo"
).split()
#: Content words to an anchor.
CHAIN = 2
DIGITS = 8
#: Ids to a cell of neighbours, a power of 2; and bits that one level of their order resolves.
CELL, LEVEL_BITS = 32, 16


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the sorted distinct signature hashes of the whole text (BIGINT below 2**32).

    A null or empty text has none. Where a text has no anchor, each of its words is taken as one, so that texts without
    common words still have chains; a text of one or two words gives one chain of what there is.
    """
    words, content, spots = f"__{out}_w", f"__{out}_c", f"__{out}_a"
    anchor = set(ANCHORS)
    df = df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    df = df.withColumn(content, F.filter(words, lambda w: ~w.isin(anchor)))
    spot = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchor), i).otherwise(-1)), lambda i: i >= 0)
    df = df.withColumn(spots, spot)
    # j anchors stand before the anchor at i, hence i - j content words, and the chain starts right there.
    chained = F.transform(
        spots,
        lambda i, j: F.xxhash64(F.get(words, i), F.coalesce(F.get(content, i - j), F.lit("")), F.coalesce(F.get(content, i - j + 1), F.lit(""))),
    )
    plain = F.transform(words, lambda w, i: F.xxhash64(w, F.coalesce(F.get(words, i + 1), F.lit("")), F.coalesce(F.get(words, i + 2), F.lit(""))))
    hashes = F.when(F.size(spots) > 0, chained).otherwise(plain)
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))))))
    return df.drop(words, content, spots)


def as_text(sigs: str) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones. Lengths alone settle the empty and the equal."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, near_id, similarity): pairs of class representatives whose signature sets have Jaccard >= threshold.

    Documents of equal signature sets form a class, named by its smallest doc_id; see `classes`. Sets are partitioned by
    length so that a pair can only reach the threshold within a class or with the next one, and met through their first
    |A| - ceil(t |A|) + 1 signatures in order of rarity, which any two sets of that similarity share one of. Empty sets
    are similar to none but each other. Null ids are ignored.
    """
    sets = cut(signatures(docs.where("doc_id is not null").select("doc_id", "text"), "text", "sigs").groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).where("size(sigs) > 0"))
    grown = F.floor(F.log(F.size("sigs")) / F.lit(-math.log(threshold))).cast("int")
    each = sets.select("doc_id", F.size("sigs").alias("n"), grown.alias("part"), F.explode("sigs").alias("sig"))
    seen = cut(each.groupBy("sig").agg(F.count("*").alias("df")))
    ranked = each.join(seen, "sig").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "sig")))
    first = cut(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("doc_id", "n", "part", "sig"))
    other = first.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)))
    a, b = first.alias("a"), other.alias("b")
    met = a.join(b, ["sig", "part"]).where("a.doc_id < b.doc_id and least(a.n, b.n) >= {} * greatest(a.n, b.n)".format(threshold))
    pairs = met.select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("near_id")).distinct()
    full = pairs.join(sets.select("doc_id", F.col("sigs").alias("x")), "doc_id").join(sets.select(F.col("doc_id").alias("near_id"), F.col("sigs").alias("y")), "near_id")
    return full.withColumn("similarity", likeness("x", "y")).where(F.col("similarity") >= threshold).select("doc_id", "near_id", "similarity")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id with the same signature set."""
    prints = signatures(docs.select("doc_id", "text"), "text", "sigs").select("doc_id", F.sha2(as_text("sigs").cast("binary"), 256).alias("set"))
    prints = cut(prints)
    return prints.join(cut(prints.groupBy("set").agg(F.min("doc_id").alias("class_id"))), "set").select("doc_id", "class_id")


def following(keys: DataFrame, bits: int) -> DataFrame:
    """(key, next): the next larger of the distinct keys (BIGINT, `bits` significant bits), or null after the last.

    Keys are put in order inside groups that share all but their last 16 bits, of 65,536 at most, and so are the groups
    themselves, up to the top, where there are few enough for one task. No more than that is ever sorted together.
    """
    if bits <= LEVEL_BITS:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    inside = keys.withColumn("group", F.shiftright("key", LEVEL_BITS))
    groups = cut(inside.groupBy("group").agg(F.min("key").alias("first")))
    after = following(groups.select(F.col("group").alias("key")), bits - LEVEL_BITS)
    onward = after.join(groups.select(F.col("group").alias("next"), "first"), "next").select(F.col("key").alias("group"), "first")
    inside = inside.withColumn("next", F.lead("key").over(Window.partitionBy("group").orderBy("key")))
    return inside.join(cut(onward), "group", "left").select("key", F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the row that follows by doc_id (then text), the first row's after the last.

    Rows are dealt into cells of CELL consecutive ids, so a cell has so many ids at most wherever the ids are dense;
    inside a cell they are put in order, and the last of each meets the first of the next cell that has any. Null texts
    count as empty; a row with a null id has no place in the order and is followed by an empty text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cell = F.shiftright("doc_id", CELL.bit_length() - 1)
    named = rows.where("doc_id is not null").withColumn("cell", cell)
    cells = cut(named.groupBy("cell").agg(F.count("*").alias("n")).select(F.col("cell").alias("key")))
    link = cut(following(cells, 64 - CELL.bit_length() + 1))
    first = cells.agg(F.min("key")).first()[0]  # one number
    link = link.select(F.col("key").alias("cell"), F.coalesce("next", F.lit(first).cast("bigint")).alias("next_cell"))
    order = Window.partitionBy("cell").orderBy("doc_id", "text")
    heads = named.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("cell").alias("next_cell"), F.col("text").alias("head"))
    # The text that follows each cell meets its rows where they are in order, so texts are dealt out once.
    after = link.join(heads, "next_cell").select("cell", "head")
    placed = named.withColumn("next_text", F.lead("text").over(order)).join(after, "cell")
    placed = placed.select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))
    return placed.unionByName(rows.where("doc_id is null").withColumn("next_text", F.lit("")))


def op7_query(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    for text, out in (("text", "x"), ("edited", "e"), ("next_text", "y")):
        rows = signatures(rows, text, out)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("x").alias("fingerprint"),
        as_text("e").alias("edited_fingerprint"), likeness("x", "e").alias("near_edited"), likeness("x", "y").alias("near_next"),
    )
