"""Document fingerprints as Merkle trees over sections and paragraphs, in DataFrame functions only.

A text is cut at line feeds into paragraphs, at blank lines into sections, and a paragraph after `.`, `!` or `?` and a
space into sentences, the leaves. A leaf's digest is the SHA-256 of its bytes, that of a paragraph, section or text the
SHA-256 of its children's digests joined. Equal texts have equal roots, and texts that differ have different ones: the
joined digests have a fixed width and a separator that no digest holds, so they fix the shape of the tree.

Two trees are compared from the root down. Sections that both have are shared whole; only the paragraphs of the others
are compared, and only the sentences of paragraphs that differ. The share of leaves found this way measures likeness;
the places where the trees differ are the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import own_column

#: Documents in a range of ids that is sorted as one; a range keeps its texts in memory up to this count.
RANGE_ROWS = 4_000
MAX_RANGES = 10_000


_LEAF = 65  # characters of a digest and the sign after it


def tree(text: Column) -> Column:
    """Struct of the root and the sections; a null text counts as empty.

    A section is the digests of its sentences, joined by `.` within paragraphs and `|` between them: as long as these
    are equal, so are the digests of the paragraphs and of the section.
    """

    def sentences(p: Column) -> Column:
        return F.array_join(F.transform(F.split(p, "(?<=[.!?]) "), lambda x: F.sha2(x, 256)), ".")

    def section(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, "\n"), sentences), "|")

    def digest(s: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.split(s, r"\|"), lambda p: F.sha2(p, 256)), "."), 256)

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)
    made = F.transform(F.array(sections), lambda t: F.struct(F.sha2(F.array_join(F.transform(t, digest), "."), 256).alias("root"), t.alias("sections")))
    return made[0]


def _leaves(branches: Column) -> Column:
    """How many leaves some branches have."""
    return F.aggregate(branches, F.lit(0), lambda n, b: n + ((F.char_length(b) + 1) / _LEAF).cast("int"))


def _below(branches: Column, sign: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(branches, lambda b: F.split(b, sign))))


def likeness(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """`df` with the share of the leaves of two trees that both have, from 0 to 1.

    Shared sections and paragraphs count with all their leaves; below the others leaves are compared as sets.
    """
    names = [own_column(df, f"_{x}") for x in ("pa", "pb", "la", "lb", "same")]
    pa, pb, la, lb, same = names
    a, b = F.col(f"{left}.sections"), F.col(f"{right}.sections")
    staged = df.withColumns({pa: _below(F.array_except(a, b), r"\|"), pb: _below(F.array_except(b, a), r"\|"), same: _leaves(F.array_intersect(a, b))})
    staged = staged.withColumns(
        {
            la: _below(F.array_except(pa, pb), r"\."),
            lb: _below(F.array_except(pb, pa), r"\."),
            same: F.col(same) + _leaves(F.array_intersect(pa, pb)),
        }
    )
    both = F.size(F.array_intersect(la, lb))
    share = (F.col(same) + both) / (F.col(same) + F.size(la) + F.size(lb) - both)
    return staged.withColumn(out, share).drop(*names)


def edits(left: Column, right: Column) -> Column:
    """Where two trees differ: array of (section, paragraph), both from 0.

    Equal sections are left out as a whole; a section that only one tree has counts as different with paragraph -1.
    """

    def inner(i: Column) -> Column:
        a, b = F.split(F.get(left["sections"], i), r"\|"), F.split(F.get(right["sections"], i), r"\|")
        whole = F.array(F.struct(i.alias("section"), F.lit(-1).alias("paragraph")))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda j: ~F.get(a, j).eqNullSafe(F.get(b, j)))
        return F.when(a.isNull() | b.isNull(), whole).otherwise(
            F.transform(places, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        )

    n = F.greatest(F.size(left["sections"]), F.size(right["sections"]))
    differing = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: ~F.get(left["sections"], i).eqNullSafe(F.get(right["sections"], i)),
    )
    return F.flatten(F.transform(differing, inner))


def with_next(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """`df` with the text of the next row by descending `key`; the row after the last is the first.

    Rows are cut into ranges of keys of bounded size and each range is sorted on its own. The upper bound
    of a range is a key that occurs, and its rows are also dealt, as guests, to the range above, whose last
    row they follow; so no range needs another's result. Rows with equal keys follow each other by text;
    rows without a key come last. A single row follows itself. No rows: none.
    """
    n = df.count()
    if not n:
        return df.withColumn(out, F.lit(None).cast("string"))
    parts = min(max(1, n // RANGE_ROWS), MAX_RANGES)
    low = -(1 << 63)
    held = F.coalesce(F.col(key).cast("long"), F.lit(low))
    shares = [(i + 1) / parts for i in range(parts)]
    found = df.select(F.percentile_approx(held, shares, 10 * parts).alias("q"), F.max(held).alias("top")).first()
    bounds = sorted({*(b for b in found["q"] if b < found["top"]), found["top"]})
    step = max(1, int(len(bounds) ** 0.5))
    k, part, guest = own_column(df, "_key"), own_column(df, "_part"), own_column(df, "_guest")
    marks = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    skipped = F.size(F.filter(coarse, lambda b: b < F.col(k))) * step
    place = skipped + F.size(F.filter(F.slice(marks, skipped + 1, F.lit(step)), lambda b: b < F.col(k)))
    above = (F.col(part) + 1) % len(bounds)
    is_bound = F.array_contains(F.slice(marks, F.col(part) + 1, F.lit(1)), F.col(k))
    own = F.struct(F.col(part).alias("part"), F.lit(False).alias("guest"))
    other = F.struct(above.alias("part"), F.lit(True).alias("guest"))
    seat = own_column(df, "_seat")
    dealt = (
        df.withColumn(k, held)
        .withColumn(part, place.cast("int"))
        .withColumn(seat, F.explode(F.when(is_bound, F.array(own, other)).otherwise(F.array(own))))
        .withColumn(part, F.col(f"{seat}.part"))
        .withColumn(guest, F.col(f"{seat}.guest"))
        .drop(seat)
    )
    order = Window.partitionBy(part).orderBy(F.col(guest), F.col(k).desc(), F.col(text).asc_nulls_first())
    return dealt.withColumn(out, F.lead(text).over(order)).filter(~F.col(guest)).drop(k, part, guest)


def half_edited(text: Column, other: Column) -> Column:
    """The last half (rounded down) of the characters replaced by the first as many of `other`."""
    text, other = F.coalesce(text, F.lit("")), F.coalesce(other, F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its half-edited text, their likeness, and where the edits are.

    `edits` lists `section:paragraph` of the places where the edited text differs, joined by commas. Null texts count as
    empty, rows without doc_id come last in the order of ids, repeated rows each give a row, no rows give none; other
    columns are ignored.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(plain, "doc_id", "text", "next").withColumn("edited", half_edited(F.col("text"), F.col("next")))
    slim = paired.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("tree"),
        tree(F.col("edited")).alias("edited_tree"),
        tree(F.col("next")).alias("next_tree"),
    )
    compared = likeness(likeness(slim, "tree", "edited_tree", "near_edited"), "tree", "next_tree", "near_next")
    places = F.transform(edits(F.col("tree"), F.col("edited_tree")), lambda e: F.concat_ws(":", e["section"].cast("string"), e["paragraph"].cast("string")))
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", F.col("tree.root").alias("fingerprint"), F.col("edited_tree.root").alias("edited_fingerprint"),
        "near_edited", "near_next", F.array_join(places, ",").alias("edits"),
    )


def _sections_sql(x: str) -> str:
    # DuckDB's expressions look neither behind nor ahead: mark the cuts with the sign that no paragraph holds.
    leaves = "list_transform(string_split(regexp_replace(p, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda l: sha256(l))"
    section = f"array_to_string(list_transform(string_split(s, chr(10)), lambda p: array_to_string({leaves}, '.')), '|')"
    return f"list_transform(string_split({x}, chr(10) || chr(10)), lambda s: {section})"


def _root_sql(x: str) -> str:
    inner = "array_to_string(list_transform(string_split(s, '|'), lambda p: sha256(p)), '.')"
    return f"sha256(array_to_string(list_transform({x}, lambda s: sha256({inner})), '.'))"


def _except_sql(a: str, b: str) -> str:
    return f"list_distinct(list_filter({a}, lambda x: not list_contains({b}, x)))"


def _below_sql(branches: str, sign: str) -> str:
    return f"list_distinct(flatten(list_transform({branches}, lambda x: string_split(x, '{sign}'))))"


def _near_ctes(name: str, a: str, b: str) -> str:
    shared = "coalesce(list_sum(list_transform(list_intersect({0}, {1}), lambda x: (length(x) + 1) // 65)), 0)"
    return f"""
{name}1 as (select doc_id, r, {a} as sa, {b} as sb, {shared.format(a, b)} as w,
  {_below_sql(_except_sql(a, b), "|")} as pa, {_below_sql(_except_sql(b, a), "|")} as pb from g),
{name}2 as (select doc_id, r, w + {shared.format("pa", "pb")} as w, {_below_sql(_except_sql("pa", "pb"), ".")} as la,
  {_below_sql(_except_sql("pb", "pa"), ".")} as lb from {name}1),
{name} as (select r, (w + len(list_intersect(la, lb))) / (w + len(la) + len(lb) - len(list_intersect(la, lb)))::double as near from {name}2)"""


SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
e as (select r, doc_id, t, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as nt from d),
f as (select r, doc_id, t, nt, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) as ed from e),
g as (select r, doc_id, t, ed, {_sections_sql("t")} as st, {_sections_sql("ed")} as se, {_sections_sql("nt")} as sn from f),
{_near_ctes("x", "st", "se")},
{_near_ctes("y", "st", "sn")},
p as (select r, array_to_string(flatten(list_transform(range(greatest(len(st), len(se))), lambda i: case
    when st[i + 1] is not distinct from se[i + 1] then []
    when st[i + 1] is null or se[i + 1] is null then [i || ':-1']
    else list_transform(list_filter(range(greatest(len(string_split(st[i + 1], '|')), len(string_split(se[i + 1], '|')))),
      lambda j: string_split(st[i + 1], '|')[j + 1] is distinct from string_split(se[i + 1], '|')[j + 1]), lambda j: i || ':' || j) end)), ',') as edits from g)
select g.doc_id, length(t)::bigint as n_chars, sha256(ed) as edited_sha256, {_root_sql("st")} as fingerprint,
  {_root_sql("se")} as edited_fingerprint, x.near as near_edited, y.near as near_next, p.edits
from g join x using (r) join y using (r) join p using (r)
"""
