"""Fingerprints of document versions: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A text is the set of its paragraphs' 64-bit digests (paragraphs are split at line breaks). A sketch has 36 cells in
three rows; a digest goes into one cell of each row, and a cell holds how many, the XOR of their digests and the XOR of the digests'
checksums. The sketches of two versions subtract cell by cell: what they share cancels. A cell with a single digest left gives
it away, taking it out of its other cells frees more ("peeling"), until every digest that differs is recovered and counted. The
likeness of two versions is shared / (shared + differing).

Peeling fails when too much differs for 36 cells. Such pairs are retried larger: their digests are dealt by hash to so many sketches
of 36 cells that about eight digests of either version meet in each. A dealt sketch that fails again is dealt to four more, under
another hash, until none is left. A long document's sketches are separate rows, so its cost is its length, and the rounds end because
ever fewer digests share a sketch.

The next document is found inside ranges of doc_id (see `order`), so no order of all rows is needed.

Defined results: null texts count as empty, and an empty text has no paragraphs; two empty versions have likeness 1. Repeated paragraphs count
once. Rows with equal doc_id follow each other by text. Rows without doc_id come before all others. The last row is followed by the
smallest doc_id, a single row by itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .order import with_next

CELLS, ROWS = 36, 3
ROW = CELLS // ROWS
PEELS = 16  # rounds; what needs more counts as a failure and is retried
SHARE = 8  # digests of one version in a dealt sketch
CELL = "named_struct('c', CAST({c} AS INT), 'k', {k}, 'h', {h})"


def paragraphs(text: str) -> str:
    """Digests of the distinct paragraphs of a text column."""
    return f"IF(text_is_empty, array(), transform(array_distinct(split({text}, '\\n')), p -> xxhash64(p)))".replace("text_is_empty", f"{text} = ''")


def _placed(digests: str, salt: str) -> str:
    """Digests with their checksum and their cell in each row."""
    cells = ", ".join(f"'i{t}', CAST(pmod(shiftright(z, {16 * t}), {ROW}) + {ROW * t} AS INT)" for t in range(ROWS))
    return (f"transform({digests}, k -> get(transform(array(xxhash64(k, {salt})), z -> named_struct('k', k, 'h', hash(k), {cells})), 0))")


def _here(unit: str, cell: str) -> str:
    return "(" + " OR ".join(f"{unit}.i{t} = {cell}" for t in range(ROWS)) + ")"


def sketch(digests: str, salt: str = "0") -> str:
    """The cells of a set of digests: array of (c: count, k: XOR of digests, h: XOR of checksums)."""
    zero, added = CELL.format(c="0", k="0L", h="0"), CELL.format(c="s.c + 1", k="s.k ^ u.k", h="s.h ^ u.h")
    return (f"get(transform(array({_placed(digests, salt)}), us -> transform(sequence(0, {CELLS - 1}), "
            f"j -> aggregate(us, {zero}, (s, u) -> IF({_here('u', 'j')}, {added}, s)))), 0)")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> {CELL.format(c='x.c - y.c', k='x.k ^ y.k', h='x.h ^ y.h')})"


def peel(cells: str, salt: str = "0") -> str:
    """(cells, a, b) after peeling: what is left in the cells, and how many digests only the first and only the second version has."""
    single = "array_distinct(filter({0}, c -> abs(c.c) = 1 AND c.h = hash(c.k)))"
    where = ", ".join(f"'i{t}', CAST(pmod(shiftright(z, {16 * t}), {ROW}) + {ROW * t} AS INT)" for t in range(ROWS))
    located = (f"transform({single.format('s.cells')}, p -> get(transform(array(xxhash64(p.k, {salt})), "
               f"z -> named_struct('c', p.c, 'k', p.k, 'h', p.h, {where})), 0))")
    taken = CELL.format(c="x.c - u.c", k="x.k ^ u.k", h="x.h ^ u.h")
    step = (f"named_struct('cells', transform(s.cells, (c, j) -> aggregate(found, c, (x, u) -> IF({_here('u', 'j')}, {taken}, x))), "
            "'a', s.a + size(filter(found, f -> f.c = 1)), 'b', s.b + size(filter(found, f -> f.c = -1)))")
    once = f"get(transform(array({located}), found -> IF(size(found) = 0, s, {step})), 0)"
    return f"aggregate(sequence(1, {PEELS}), named_struct('cells', {cells}, 'a', 0, 'b', 0), (s, r) -> {once})"


def _counts(a: str, b: str, salt: str = "0") -> str:
    """(a, b) recovered counts from two sketches, null where peeling fails."""
    return (f"get(transform(array({peel(subtract(a, b), salt)}), s -> IF(forall(s.cells, c -> c.c = 0 AND c.k = 0 AND c.h = 0), "
            "named_struct('a', s.a, 'b', s.b), NULL)), 0)")


def text_of(cells: str) -> str:
    """A sketch as text: count, digest and checksum of each cell in hexadecimal."""
    return (f"array_join(transform({cells}, c -> concat(lpad(hex(c.c & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), "
            "lpad(hex(c.h & 4294967295L), 8, '0'))), '')")


def next_in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, units, next_text, next_units) with the text and paragraphs of the document that follows by doc_id."""
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("units", F.expr(paragraphs("text"))))
    # only a table of nothing but rows without doc_id has a row without next
    return (with_next(rows, "doc_id", {"text": "next_text", "units": "next_units"}, "text")
            .withColumn("next_text", F.coalesce("next_text", F.lit(""))).withColumn("next_units", F.coalesce("next_units", F.array().cast("array<bigint>"))))


def likeness(pairs: DataFrame) -> DataFrame:
    """(row, likeness) for pairs (row, a, b) of digest arrays: sketches of 36 cells first, then ever larger."""
    size = pairs.withColumn("na", F.size("a")).withColumn("nb", F.size("b"))
    tried = settle(size.withColumn("got", F.expr(_counts(sketch("a"), sketch("b")))), "sketched")
    out = [tried.filter("got IS NOT NULL").select("row", F.col("got.a").cast("bigint").alias("only_a"), F.col("got.b").cast("bigint").alias("only_b"))]
    failed = tried.filter("got IS NULL")
    dealt = (failed.withColumn("shares", F.ceil(F.greatest("na", "nb") / SHARE).cast("int"))
             .select("row", "shares", F.explode(F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(True).alias("first"))),
                                                         F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(False).alias("first"))))).alias("u"))
             .withColumn("share", F.expr("CAST(pmod(xxhash64(u.k, -1), shares) AS BIGINT)")))
    number = 0
    while True:
        number += 1
        salt = str(number)
        met = dealt.groupBy("row", "share").agg(
            F.collect_list(F.when(F.col("u.first"), F.col("u.k"))).alias("a"), F.collect_list(F.when(~F.col("u.first"), F.col("u.k"))).alias("b"))
        again = settle(met.withColumn("got", F.expr(_counts(sketch("a", salt), sketch("b", salt), salt))), "sketched")
        out.append(again.filter("got IS NOT NULL").select("row", F.col("got.a").cast("bigint").alias("only_a"), F.col("got.b").cast("bigint").alias("only_b")))
        left = again.filter("got IS NULL")
        if left.isEmpty():
            break
        dealt = (left.select("row", "share", F.explode(F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(True).alias("first"))),
                                                               F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(False).alias("first"))))).alias("u"))
                 .withColumn("share", F.expr(f"share * 4 + pmod(xxhash64(u.k, -{number + 1}), 4)")))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    sums = every.groupBy("row").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))
    shared = F.col("na") - F.col("only_a")
    whole = shared + F.col("only_a") + F.col("only_b")
    return (tried.select("row", "na").join(sums, "row")
            .select("row", F.when(whole == 0, F.lit(1.0)).otherwise(shared / whole).alias("likeness")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by the beginning of the next document."""
    turned = (next_in_order(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
              .withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS INT)), substring(next_text, 1, CAST(n_chars div 4 AS INT)))"))
              .withColumn("edited_units", F.expr(paragraphs("edited")))
              .select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      "units", "edited_units", "next_units"))
    versions = settle(turned, "versions")
    both = (versions.select((F.col("row") * 2).alias("row"), F.col("units").alias("a"), F.col("edited_units").alias("b"))
            .union(versions.select((F.col("row") * 2 + 1).alias("row"), F.col("units").alias("a"), F.col("next_units").alias("b"))))
    near = likeness(both)
    per_row = near.groupBy(F.expr("row div 2").alias("row")).agg(
        F.max(F.when(F.col("row") % 2 == 0, F.col("likeness"))).alias("near_edited"), F.max(F.when(F.col("row") % 2 == 1, F.col("likeness"))).alias("near_next"))
    return versions.join(per_row, "row").select(
        "doc_id", "n_chars", "edited_sha256", F.expr(text_of(sketch("units"))).alias("fingerprint"),
        F.expr(text_of(sketch("edited_units"))).alias("edited_fingerprint"), "near_edited", "near_next")
