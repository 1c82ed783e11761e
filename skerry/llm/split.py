"""Splitting of oversized items at natural boundaries (problem 2).

Bounded-quantifier regular expressions do the cutting inside the JVM. Their alternatives are
ordered by the strength of the boundary they end at (rest of the text, blank line, newline,
end of sentence, space, any character); each takes as much as it may, up to the limit. The
pieces' overlap is looked up in the cuts before them by SQL array functions: two cuts in a
row are never both short, so a fixed number of them holds it. How strong a boundary a text
can be cut at throughout is found the same way: what consecutive bounded parts of one strength
use up goes, and the rest is tried with the next weaker one as well.
There is no shuffle and no Python: the operator is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_pattern(limit: int, overlap: int) -> str:
    """Pattern whose successive matches are the new (not repeated) parts of the pieces.

    The first piece may take ``limit`` code points, each later one ``limit - overlap``,
    for it repeats ``overlap``. A boundary in the upper half of the room is preferred, a
    stronger one to a weaker; below that the last space counts; then any character. A piece
    that ends at a blank line has it whole, so no blank line looked for is longer than the room.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")

    def alternatives(room: int) -> str:
        low = max(1, room // 2)
        return "|".join(
            [
                rf".{{1,{room}}}\z",
                rf".{{{low},{room}}}(?<=\n)(?<=\n[ \t\r]{{0,{room}}}\n)",
                rf".{{{low},{room}}}(?<=\n)",
                rf".{{{low},{room}}}(?<=[.!?][ \t\r])",
                rf".{{{low},{room}}}(?<=[ \t\r])",
                rf".{{1,{room}}}(?<=[ \t\r\n])",
                rf".{{1,{room}}}",
            ]
        )

    return rf"(?s)\A(?:{alternatives(limit)})|(?:{alternatives(limit - overlap)})"


def boundary_of(text: Column, limit: int) -> Column:
    """The first of paragraph, line, sentence and word whose trimmed parts all fit ``limit``, else none.

    A part is at most ``limit`` code points, the last no space, tab, carriage return or newline,
    up to its boundary. Parts of the strongest boundary are taken from the front as long as
    they fit; if something is left, parts of the next weaker one are taken from that, and so on.
    A weaker boundary's parts lie within a stronger one's, so what is used up needn't be looked
    at again, and each level reads no character much more than once.
    """
    blank, inked = r"[ \t\r\n]", r"(?<![ \t\r\n])"
    parts = {
        "paragraph": rf"(?s:.{{1,{limit}}}?){inked}(?:[ \t\r]*+\n[ \t\r]*+\n|{blank}*+\z)",
        "line": rf"[^\n]{{1,{limit}}}?{inked}[ \t\r]*+(?:\n|\z)",
        "sentence": rf"[^\n]{{1,{limit}}}?{inked}(?:[ \t\r]*+(?:\n|\z)|(?<=[.!?])[ \t\r]++)",
        "word": rf"[^ \t\r\n]{{1,{limit}}}+(?:{blank}|\z)",
    }

    def level(names: list[str], rest: Column) -> Column:
        if not names:
            return F.lit("none")
        left = F.regexp_replace(rest, rf"\G{blank}*+(?:\z|{parts[names[0]]})", "")
        # a lambda over one element names what is left, so that it is computed once
        return F.get(F.transform(F.array(left), lambda x: F.when(x == "", F.lit(names[0])).otherwise(level(names[1:], x))), F.lit(0))

    return level(list(parts), text)


def split_oversized(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    limit: int = 1800,
    overlap: int = 250,
    whole: bool = True,
) -> DataFrame:
    """Pieces of every row of ``df``: ``keys`` then piece_no, n_pieces, piece, n_new, boundary.

    * ``piece_no`` counts from 0; ``n_new`` is the number of code points of the piece that
      the piece before doesn't hold, so the last ``n_new`` of all pieces, put together, are
      the text again.
    * A text of at most ``limit`` code points is its own only piece, with a null boundary;
      without ``whole`` such texts, null ones and empty ones are left out.
    * A null text gives one row with a null piece, an empty text one with an empty piece.
    * Repeated rows are split each for itself; an empty table gives no rows.
    * Other columns of ``df`` are left out, so their names can't clash.
    """
    body = F.col(text)
    over = F.length(body) > limit
    cuts = F.regexp_extract_all(body, F.lit(cut_pattern(limit, overlap)), F.lit(0))
    # two cuts in a row have at least half the room, for a short one ends at the last space of its room
    back = 2 * -(-overlap // max(1, (limit - overlap) // 2))

    def piece(cut: Column, at: Column) -> Column:
        before = F.array_join(F.slice(F.col("__cuts"), F.greatest(F.lit(1), at - back + 1), F.least(F.lit(back), at)), "")
        return F.struct(F.concat(F.right(before, F.lit(overlap)), cut).alias("piece"), F.length(cut).alias("n_new"))

    pieces = F.transform("__cuts", piece) if overlap else F.transform("__cuts", lambda cut: F.struct(cut.alias("piece"), F.length(cut).alias("n_new")))
    # an inner explode would have the optimizer compute the pieces once more, to filter out empty arrays, of which there are none
    return (
        (df if whole else df.filter(over))
        .select(*keys, F.when(over, cuts).otherwise(F.array(body)).alias("__cuts"), F.when(over, boundary_of(body, limit)).alias("__boundary"))
        .select(*keys, "__boundary", pieces.alias("__pieces"))
        .select(*keys, "__boundary", F.size("__pieces").cast("bigint").alias("n_pieces"), F.posexplode_outer("__pieces").alias("piece_no", "__piece"))
        .select(
            *keys,
            F.col("piece_no").cast("bigint").alias("piece_no"),
            "n_pieces",
            F.col("__piece.piece").alias("piece"),
            F.col("__piece.n_new").cast("bigint").alias("n_new"),
            F.col("__boundary").alias("boundary"),
        )
    )
