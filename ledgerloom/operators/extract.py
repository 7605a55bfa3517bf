"""Document text to typed line items. Pages stay pages; lines keep their numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, predicates, text
from ledgerloom.staging import staged

PAGE = ["file", "page"]
CODE = "(?:" + "|".join(money.ISO) + ")"
DMY = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
FIGURE = r"-?\(?[0-9]{1,3}(?:[ ,][0-9]{3})*(?:[.,][0-9]{2})?\)?|-?\(?[0-9]+(?:[.,][0-9]{2})?\)?"


#: What a line may be, by a letter; a line's code is a one and then a binary place for each, in this order.
LINE_KINDS = {
    "t": r"^\s*[0-9]{2}\s*$",  # two digits
    "i": r"^\s*[0-9]{1,3}\s*$",  # a small whole number
    "a": r"^\s*[-(]?\s*[0-9]{1,3}(?:[ ,.]?[0-9]{3})*(?:[.,][0-9]{2})?\)?\s*$",  # an amount alone
    "k": rf"(?i)^\s*{CODE}\s*$",  # a currency alone
    "e": rf"(?i)(?:^|[^A-Za-z])(?=[A-Z]{{3}}\s*$){CODE}\s*$",  # ends in a currency
    "d": rf"^\s*{DMY}\b",  # begins with a date
    "z": rf"{DMY}\s*$",  # ends in a date
    "h": rf"(?i)(?=[A-Z]{{3}}\s+[0-9]){CODE}\s+{DMY}",  # holds a currency and a date behind it
    "n": r"[0-9](?<![0-9.,/:-][0-9])[0-9,]*[0-9]\s*$",  # ends in a whole number of two digits or more
    "s": r"^\s*$",  # blank, or a heading or total: nothing is read across it
}


def _like(kinds: str, without: str = "") -> str:
    """A pattern for the code of a line that is all of ``kinds`` and none of ``without``."""
    return "1" + "".join("1" if k in kinds else "0" if k in without else "." for k in LINE_KINDS)


def _is(code: Column, kind: str) -> Column:
    """Whether a line's code, or none, has ``kind``."""
    return F.coalesce(F.substring(code, 2 + list(LINE_KINDS).index(kind), 1) == "1", F.lit(False))


def _wrapping() -> str:
    """How many lines belong together, as a pattern over the codes of a page's lines; the first form that fits counts."""
    cents, amount, code, text_ = _like("t"), _like("a"), _like("k"), _like("", "aks")
    amounts = f"(?:{_like('an')}{cents}|{amount})*+"
    forms = [
        f"{_like('zh')}{code}{amounts}",  # row head up to its date, currency, amounts
        f"{_like('z')}(?:{text_}){{1,3}}{code}{amount}",  # date, up to three lines of text, currency, amount
        f"{_like('z')}{code}(?:{amount})?",  # date, currency, perhaps amount
        f"{_like('e')}(?:{_like('dn')}{cents}|{_like('d')}{amounts})",  # currency, date and what follows
        f"{_like('hn')}{cents}",  # row whose cents are below
        f"{_like('h')}{amounts}",  # row whose amount is below
        f"{_like('i')}{cents}",  # 55 / 28
        f"{_like('n')}{cents}",  # ... 867 / 60
        f"{_like('e')}(?:{_like('an')}{cents}|{amount})",  # ... SGD / 12.00
        f"{text_}{code}{amount}",  # text, currency, amount
    ]
    # A code's first place stays outside, to be marked.
    return "1(" + "|".join(form[1:] for form in [*forms, _like("")]) + ")"


def _line_code(c: Column) -> Column:
    """The code of a line. Lines of figures alone and lines of text are asked for what they can be, and for dates only where there is a slash."""
    kinds = list(LINE_KINDS)
    place = lambda k, said: F.when(said, 2 ** (len(kinds) - 1 - kinds.index(k))).otherwise(0)
    is_ = lambda k: place(k, c.rlike(LINE_KINDS[k]))
    days = F.when(F.contains(c, F.lit("/")), is_("d") + is_("z") + is_("h")).otherwise(0)
    number = place("n", c.rlike(LINE_KINDS["n"]) & ~c.rlike(LINE_KINDS["z"]))
    stop = place("s", predicates.is_total_row(c) | predicates.is_table_header(c))
    figures, words = is_("t") + is_("i") + is_("a") + number + is_("s"), is_("k") + is_("e") + days + number + stop
    return F.bin(F.when(c.rlike(r"^[\s0-9.,()-]*$"), figures).otherwise(words) + 2 ** len(kinds))


def mended(pages: DataFrame) -> DataFrame:
    """``pages`` with ``lines``: (line_no, last_no, line) of its lines with hard-wrapped ones joined.

    Every line is classified once, and one pass over the codes marks where lines that
    belong together begin. Cents are joined by a dot, everything else by a blank; a line that
    isn't joined stays as it is, but for cents a blank apart at its end. A date's year
    is no amount that cents could follow.
    """
    usual = text.once(F.coalesce("text", F.lit("")), lambda c: F.when(c.rlike("[\u00a0\u2007\u202f]"), F.translate(c, "\u00a0\u2007\u202f", "   ")).otherwise(c))
    df = pages.withColumn("raw", F.split(usual, r"\R")).withColumn("codes", F.array_join(F.transform("raw", _line_code), ""))
    df = df.withColumn("marks", F.regexp_extract_all(F.regexp_replace("codes", _wrapping(), "#$1"), F.lit(f"([#1][01]{{{len(LINE_KINDS)}}})"), F.lit(1)))
    begins = lambda m: F.startswith(m, F.lit("#"))

    def piece(raw: Column, i: Column) -> Column:
        mark, before = F.get("marks", i), F.get("marks", i - 1)
        head = F.when(F.coalesce(begins(F.get("marks", i + 1)), F.lit(True)), raw).otherwise(F.rtrim(raw))
        joint = F.when(_is(mark, "t") & _is(before, "n"), ".").otherwise(" ")
        return F.when(begins(mark), F.concat_ws("\n", F.lit(""), head)).otherwise(F.concat_ws("", joint, F.trim(raw)))

    starts = F.filter(F.transform("marks", lambda m, i: F.when(begins(m), i)), lambda i: i.isNotNull())
    df = df.withColumns({"joined": F.split(F.array_join(F.transform("raw", piece), ""), "\n"), "starts": starts, "n": F.size("raw")})
    apart = lambda c: F.when(c.rlike(r"[0-9][ \t]+[0-9]{2}[ \t]*$"), F.regexp_replace(c, r"(?<![0-9.,/:-])([0-9]{2,})[ \t]+([0-9]{2})[ \t]*$", "$1.$2")).otherwise(c)
    line = lambda at, i: F.struct(at.alias("line_no"), (F.coalesce(F.get("starts", i + 1), "n") - 1).alias("last_no"), text.once(F.get("joined", i + 1), apart).alias("line"))
    # Behind an array of one row, so that no filter on the lines brings their making in once more.
    return df.select(*pages.columns, F.explode(F.array(F.transform("starts", line))).alias("lines"))


def wrapped_lines(pages: DataFrame) -> DataFrame:
    """(file, page, line_no, last_no, line): a page's lines with hard-wrapped ones joined; ``line_no`` and ``last_no`` are lines of the page."""
    return mended_lines(mended(pages))


def mended_lines(pages: DataFrame, *more: str) -> DataFrame:
    """:func:`wrapped_lines` of pages that are :func:`mended` already, with their columns ``more``."""
    return pages.select(*PAGE, *more, F.inline(F.filter("lines", lambda x: x["line"].isNotNull())))


def mended_text(lines: str = "lines") -> Column:
    """The lines of a :func:`mended` page as one text."""
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def unwrap(pages: DataFrame) -> DataFrame:
    """``pages`` with hard-wrapped lines joined: :func:`wrapped_lines` as text again."""
    return mended(pages).withColumn("text", mended_text()).drop("lines")


def lines_of(pages: DataFrame, *more: str) -> DataFrame:
    """(file, page, line_no, line): the lines of every page, in order, with the page's columns ``more``."""
    return pages.select(*PAGE, *more, F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))


def kept(row: Column, wanted: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
    """The fields of ``row`` (a struct) where it isn't null and ``wanted``, else no row: a filter that doesn't work the row out anew."""
    return F.inline(F.filter(F.array(row), lambda x: x.isNotNull() & wanted(x)))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, behind an array of one row, so that no later step works them out anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_context(lines: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Non-blank lines with ``prev1``, ``prev2``... and ``next1``... of the same page, and ``ends`` and ``next_ends``: the last line of the page that a line and the one behind it reach.

    ``lines`` may be pages that are :func:`mended`: these bring their lines along, so that nothing is dealt out or sorted.
    """
    if "lines" in lines.columns:
        said = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["last_no"].alias("ends"), F.trim(x["line"]).alias("line")))
        at = lambda ls, i, c, name: F.get(ls, i)[c].alias(name)
        above = lambda ls, i: [at(ls, i - k, "line", f"prev{k}") for k in range(1, before + 1)]
        below = lambda ls, i: [at(ls, i + k, "line", f"next{k}") for k in range(1, after + 1)]
        row = lambda ls: lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["ends"].alias("ends"), at(ls, i + 1, "ends", "next_ends"), *above(ls, i), *below(ls, i))
        rows = text.once(F.filter(said, lambda x: x["line"] != ""), lambda ls: F.transform(ls, row(ls)))
        return lines.select(*[c for c in lines.columns if c not in ("text", "lines")], F.inline(rows))
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    df = lines.where(F.trim("line") != "").withColumns({"line": F.trim("line"), "ends": F.col("last_no" if "last_no" in lines.columns else "line_no")})
    near = {f"prev{k}": F.lag("line", k).over(order) for k in range(1, before + 1)} | {f"next{k}": F.lead("line", k).over(order) for k in range(1, after + 1)}
    return df.withColumns(near | {"next_ends": F.lead("ends").over(order)})


def receipt_rows(lines: DataFrame) -> DataFrame:
    """(file, page, line_no, date, currency, description, amount, form) of one-line receipts.

    Forms: ``wide`` (columns two blanks apart), ``row`` (currency, date, text,
    amount), ``bare`` (an amount alone).
    """
    wide = rf"^(\S.+?)\s{{2,}}(\S.+?)\s{{2,}}({CODE})\s+({DMY})\s{{2,}}(.+?)\s{{2,}}({FIGURE})\s*$"
    row = rf"(?i)({CODE})\s+({DMY})\s+(.+?)\s+({FIGURE})\s*$"
    bare = rf"^\s*({FIGURE})\s*$"
    line, none, no_desc, mark = F.col("line"), F.lit(None).cast("string"), F.lit("(no desc)"), "\u0001"
    # A form's parts (form, currency, date, amount, description) are cut out in one look; a line that hasn't the form stays as it is.
    cut = lambda p, form, groups: F.regexp_replace(line, p, mark.join([form, *groups]))

    def receipt(f: Column) -> Column:
        found = F.when(F.startswith(f, F.lit(f"wide{mark}")) | F.startswith(f, F.lit(f"row{mark}")), F.split(f, mark, 5))
        found = found.otherwise(F.when(line.rlike(bare), F.array(F.lit("bare"), none, none, F.regexp_extract(line, bare, 1), no_desc)))
        return text.once(found, lambda x: F.when(x.isNotNull(), F.struct(
            dates.parse_date(x[2]).alias("date"), F.upper(x[1]).alias("currency"), text.spaced(x[4]).alias("description"),
            money.parse_amount(F.replace(x[3], F.lit(","), F.lit(""))).alias("amount"), x[0].alias("form"),
        )))

    as_wide, as_row = cut(wide, "wide", ["$3", "$4", "$6", "$5"]), cut(rf"(?i)^.*?{row[4:]}", "row", ["$1", "$2", "$4", "$3"])
    form = text.once(as_wide, lambda w: F.when(w != line, w).otherwise(as_row))
    more = [c for c in lines.columns if c not in (*PAGE, "line_no", "last_no", "line")]
    return lines.select(*PAGE, "line_no", *more, kept(text.once(form, receipt), lambda x: x["amount"].isNotNull() & (x["description"] != "")))


def stacked_receipts(lines: DataFrame) -> DataFrame:
    """Receipts in a stack: a date line, lines of text, a currency line, an amount line. Keeps its own date.

    The text reads on up to the next currency and amount; a heading or total line
    before them ends the receipt. A further date line in between is text.
    """
    # All from the end, in one order: what is behind a line comes before it, and frames only grow.
    upward = Window.partitionBy(*PAGE).orderBy(F.desc("line_no"))
    onward = upward.rowsBetween(Window.unboundedPreceding, 0)
    next_at = lambda c: F.min(F.when(c, F.col("line_no"))).over(onward)
    df = lines.where(F.trim("line") != "").withColumn("line", F.trim("line")).withColumns({"next1": F.lag("line").over(upward), "next_no": F.lag("line_no").over(upward)})
    code, figure = F.col("line").rlike(rf"(?i)^{CODE}$"), F.col("next1").rlike(r"^[0-9]{1,7}[.,][0-9]{2}$")
    stop = predicates.is_table_header(F.col("line")) | predicates.is_total_row(F.col("line"))
    df = df.withColumns({"pair_at": next_at(code & figure), "stop_at": next_at(stop)})
    begins = F.col("line").rlike(rf"^{DMY}$") & (F.col("stop_at").isNull() | (F.col("pair_at") < F.col("stop_at")))
    df = df.where("pair_at is not null")
    only = lambda c: F.max(F.when(F.col("line_no") == F.col("pair_at"), F.col(c)))
    read = F.struct("line_no", "line", begins.alias("begins"))
    df = df.groupBy(*PAGE, "pair_at").agg(F.sort_array(F.collect_list(read)).alias("read"), only("line").alias("code"), only("next1").alias("figure"), only("next_no").alias("last_no"))
    first = F.get(F.filter("read", lambda x: x["begins"]), F.lit(0))
    df = df.where(F.exists("read", lambda x: x["begins"])).select("*", F.inline(F.array(F.struct(first["line_no"].alias("start"), first["line"].alias("day")))))
    df = df.withColumn("words", F.filter("read", lambda x: (x["line_no"] > F.col("start")) & (x["line_no"] < F.col("pair_at")))).where(F.size("words") > 0)
    description = text.spaced(F.array_join(F.transform("words", lambda w: w["line"]), " "))
    return df.select(*PAGE, F.col("start").alias("line_no"), dates.parse_date(F.col("day")).alias("date"), F.upper("code").alias("currency"), description.alias("description"), money.parse_amount(F.col("figure")).alias("amount"), "last_no")


def dual_currency_due(lines: DataFrame) -> DataFrame:
    """(file, page, line_no, last_no, amount) in SGD where an amount due is given in USD and SGD, on a line or across two; once per match."""
    figure = r"[$€£¥]?\s*(?<![0-9,.])([0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2}|[0-9]+\.[0-9]{2})"
    pattern = rf"(?i)\bamount\s+due\b.*?{figure}\s*USD.*?{figure}\s*SGD"
    df = with_context(lines, 0, 1)
    joined = F.concat_ws(" ", "line", "next1")
    crossing = ~F.col("line").rlike(pattern) & joined.rlike(pattern) & ~F.coalesce(F.col("next1").rlike(pattern), F.lit(False))
    hit = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 2)).when(crossing, F.regexp_extract(joined, pattern, 2))
    return df.withColumns({"hit": hit, "last_no": F.when(crossing, F.col("next_ends")).otherwise(F.col("ends"))}).where("hit is not null").select(*PAGE, "line_no", "last_no", money.parse_amount(F.regexp_replace("hit", ",", "")).alias("amount"))


#: A currency or an amount, as they are taken out of a line to leave its text.
BARE = rf"(?i)(?:\b{CODE}\b|[A-Z]{{0,2}}[$€£¥])|\(?-?[0-9][0-9,]*\.[0-9]{{2}}\)?"


def trailing_totals(lines: DataFrame, page: str = "SGD") -> DataFrame:
    """(file, page, line_no, description, currency, amount) of total lines; the text comes from up to three lines above."""
    df = with_context(lines, 3, 0).withColumn("last_no", F.col("ends"))
    stop = lambda c: c.isNull() | predicates.is_table_header(c) | predicates.says_total(c)
    usable = lambda c: F.when(predicates.is_side_cost(c), F.lit("")).otherwise(c)
    enough = lambda c: F.size(text.tokens(c)) >= 2
    prev = [F.col(f"prev{k}") for k in (1, 2, 3)]

    def above(said: Column, k: int) -> Column:
        """``said`` with the lines from ``k`` above on, until it has two telling words or something stops it."""
        if k == len(prev):
            return said
        more = F.trim(F.concat_ws(" ", usable(prev[k]), said)) if k else usable(prev[0])
        return F.when((enough(said) if k else F.lit(False)) | stop(prev[k]), said).otherwise(text.once(more, lambda c: above(c, k + 1)))

    described = F.left(F.coalesce(text.null_if_empty(text.spaced(above(F.lit(""), 0))), F.lit("Item Total")), F.lit(160))
    pick = F.when(predicates.is_trailing_total(F.col("line")), money.best_amount(F.col("line"), money.amounts(F.col("line"), F.lit(page)), F.lit(page)))
    row = text.once(pick, lambda p: F.when(money.nonzero(p["amount"]), F.struct(described.alias("description"), p["currency"].alias("currency"), p["amount"].alias("amount"))))
    return df.select(*PAGE, "line_no", "last_no", kept(row))


def labelled_amounts(lines: DataFrame, page: str = "SGD") -> DataFrame:
    """(file, page, line_no, last_no, kind, description, currency, amount): totals and items named on a line whose amount stands there or on the next; the text is the name."""
    df = with_context(lines, 1, 1)
    total = predicates.says_total(F.col("line"))
    item = F.col("line").rlike(predicates.ITEM_LABEL) & ~total
    here, below = money.amounts(F.col("line"), F.lit(page)), money.amounts(F.coalesce("next1", F.lit("")), F.lit(page))
    named = F.left(text.spaced(F.regexp_replace(F.regexp_replace("line", BARE, " "), r"[\s:;,.=-]+$", "")), F.lit(160))

    def labelled(kind: Column) -> Column:
        return F.when(kind.isNotNull(), text.once(here, lambda own: text.once(
            money.best_amount(F.col("line"), F.when(F.size(own) > 0, own).otherwise(below), F.lit(page)),
            lambda pick: F.when(money.nonzero(pick["amount"]), F.struct(F.when(F.size(own) == 0, F.col("next_ends")).otherwise(F.col("ends")).alias("last_no"), kind.alias("kind"), named.alias("description"), pick["currency"].alias("currency"), pick["amount"].alias("amount"))),
        )))

    return df.select(*PAGE, "line_no", kept(text.once(F.when(total, "total").when(item, "item"), labelled)))


FREE_FIGURE = rf"(?=[A-Z]{{3}}\s)(?<![\w.,/-])((?:{CODE}\s+)[0-9]{{1,3}}(?:,?[0-9]{{3}})*\.[0-9]{{2}})(?![\w/])"


def dated_amounts(pages: DataFrame, reach: int = 800) -> DataFrame:
    """(file, page, n, amount, currency, date, at, line_no, left): amounts of free text with the nearest date within ``reach`` characters.

    Equally near: the first; none near: the page's last date. Dates and amounts are cut
    out of a page in one pass, each with the text behind it; the last date before and the next behind an amount come
    from two running windows, so a page costs a sort of its pieces. ``left`` is what
    stands before the amount on its line, behind any date or amount there.
    """
    one, two, three = "\u0001", "\u0002", "\u0003"  # before a date, before an amount, behind either
    marked = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), f"({dates.DATE_TOKEN})", f"{one}$1{three}"), FREE_FIGURE, f"{two}$1{three}")
    parts = pages.select(*PAGE, F.posexplode(F.split(marked, f"(?=[{one}{two}])")).alias("k", "part"))
    order = Window.partitionBy(*PAGE).orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*PAGE).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # from the end: a frame that only grows
    cut, token = F.split("part", three, 2), F.left("part", F.lit(1)).isin(one, two)
    parts = parts.select(*PAGE, "k", F.when(token, F.left("part", F.lit(1))).otherwise("").alias("kind"), F.when(token, F.substring(cut[0], 2, 2**31 - 1)).otherwise("").alias("said"), F.when(token, F.get(cut, 1)).otherwise(F.col("part")).alias("rest"))
    size = F.length("said") + F.length("rest")
    broken = size - F.length(F.replace("said", F.lit("\n"))) - F.length(F.replace("rest", F.lit("\n")))
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    parts = parts.withColumns({"at": before(size), "line_no": before(broken).cast("int"), "n": before((F.col("kind") == two).cast("int")).cast("int")})
    day = F.when(F.col("kind") == one, F.struct("at", "said"))
    last = lambda frame: F.last(day, ignorenulls=True).over(frame)
    parts = parts.withColumns({"past": last(so_far), "next": last(behind), "ending": last(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "text_before": F.lag("rest").over(order)})
    near = lambda c: F.when(F.abs(F.col(f"{c}.at") - F.col("at")) <= reach, F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("apart"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.said").alias("said")))
    picked = F.least(near("past"), near("next"))["said"]
    amount = money.parse_amount(F.replace(F.regexp_extract("said", r"([0-9][0-9,]*\.[0-9]{2})", 1), F.lit(","), F.lit("")))
    left = F.coalesce(F.element_at(F.split("text_before", "\n"), -1), F.lit(""))
    return parts.where(F.col("kind") == two).select(*PAGE, "n", amount.alias("amount"), F.left("said", F.lit(3)).alias("currency"), dates.parse_date(F.coalesce(picked, "ending.said")).alias("date"), "at", "line_no", left.alias("left"))


def free_text_items(pages: DataFrame) -> DataFrame:
    """(file, page, line_no, description, currency, amount, date, source) of amounts in running text.

    The text is what stands left of the amount; while it has no two telling words, the
    line above and then the line below are taken in, unless they are headings, totals
    or side costs. Side costs themselves are no items, but totals are (``summary_total``).
    Of pages that are :func:`mended` the mended lines are read, and ``last_no`` is told.
    """
    known = "lines" in pages.columns
    if known:
        pages = pages.withColumn("text", mended_text())
    else:
        pages = pages.withColumn("lines", F.transform(F.split("text", r"\R"), lambda c, i: F.struct(i.alias("line_no"), i.alias("last_no"), c.alias("line"))))
    # A page's amounts meet its lines as a list, so neither side is dealt out by lines.
    listed = dated_amounts(pages).groupBy(*PAGE).agg(F.collect_list(F.struct("line_no", "amount", "currency", "date", "left")).alias("listed"))
    line = lambda i: F.trim(F.get("lines", i)["line"])
    near = lambda f: F.struct(F.get("lines", f["line_no"]).alias("at"), f.alias("f"), line(f["line_no"] - 1).alias("above"), line(f["line_no"] + 1).alias("below"))
    found = listed.join(pages.select(*PAGE, "lines"), PAGE).select(*PAGE, F.inline(F.transform("listed", near))).where("at is not null").select(*PAGE, "at.line_no", "at.last_no", "f.amount", "f.currency", "f.date", "f.left", "above", "below")
    good = lambda c: (F.size(text.tokens(c)) >= 2) & (F.length(c) >= 12)
    bare = lambda c: c.isNotNull() & (c != "") & ~(predicates.is_table_header(c) | predicates.is_total_row(c) | predicates.is_side_cost(c))
    own = text.compact_description(F.col("left"), 2, 12, 64)
    one = text.once(own, lambda c: F.when(good(c) | ~bare(F.col("above")), c).otherwise(F.concat_ws(" ", "above", c)))
    two = text.once(one, lambda c: F.when(good(c) | ~bare(F.col("below")), c).otherwise(F.concat_ws(" ", c, F.col("below"))))
    found = fixed(found, description=F.left(text.spaced(two), F.lit(160)))
    found = fixed(found, total=predicates.says_total(F.col("description")))
    kept = (F.col("description") != "") & (F.col("total") | ~predicates.is_side_cost(F.col("description"))) & money.nonzero(F.col("amount"))
    return found.where(kept).select(*PAGE, "line_no", *(["last_no"] if known else []), "description", "currency", "amount", "date", F.when(F.col("total"), "summary_total").otherwise("summary").alias("source"))


def ragged_rows(lines: DataFrame, page: str = "SGD") -> DataFrame:
    """(file, page, line_no, last_no, description, currency, amount, source, parent_line) of money lines without columns.

    ``text_row``: a line with an amount in a named currency; its text is what stands
    left of the amount, and grows upwards until it has two telling words.
    ``text_row_total``: the same on a total line, or a total line whose amount is on
    the next. Behind a line that says allocation or percentage, and up to a blank
    line, amounts belong to the row above it: ``text_row|echo`` where they repeat it,
    else ``text_row|alloc_part``.
    """
    order, last = Window.partitionBy(*PAGE).orderBy("line_no"), "last_no" if "last_no" in lines.columns else "line_no"
    latest = lambda c: F.last(F.when(c, F.col("line_no")), ignorenulls=True).over(order)
    bad = predicates.is_table_header(F.col("line")) | predicates.is_total_row(F.col("line")) | predicates.is_side_cost(F.col("line"))
    # Lines without a digit have no amounts, and only lines without amounts are asked whether a row may read on to them.
    figures = F.when(F.col("line").rlike("[0-9]"), money.amounts(F.col("line"), F.lit(page))).otherwise(F.array().cast("array<struct<amount:double,currency:string,start:int>>"))
    df = fixed(lines.withColumn("line", F.trim("line")), found=figures)
    alloc = predicates.holds(F.col("line"), ["allocation", "percentage"])
    df = fixed(df, alloc=alloc, total=predicates.says_total(F.col("line")), usable=F.coalesce((F.size("found") == 0) & (F.col("line") != "") & ~bad, F.lit(False)))
    df = df.withColumn("blank_at", latest(F.col("line") == "")).withColumn("alloc_at", latest(F.col("alloc")))
    inside = (F.col("alloc_at") > F.coalesce("blank_at", F.lit(-1))) & (F.col("line_no") > F.col("alloc_at"))
    df = df.withColumn("part", F.coalesce(inside, F.lit(False)))
    near = {f"prev{k}": F.lag("line", k).over(order) for k in (1, 2)} | {f"usable{k}": F.coalesce(F.lag("usable", k).over(order), F.lit(False)) for k in (1, 2)} | {"next_found": F.lead("found").over(order)}
    df = df.withColumns(near)
    df = df.withColumn("below", F.col("total") & (F.size("found") == 0) & (F.size("next_found") > 0)).withColumn("ends", F.when(F.col("below"), F.lead(last).over(order)).otherwise(F.col(last)))
    df = fixed(df, pick=money.best_amount(F.col("line"), F.when(F.col("below"), F.col("next_found")).otherwise(F.col("found")), F.lit(page)))
    taken = F.coalesce(F.lag("below").over(order), F.lit(False))
    hint = F.col("line").rlike("(?i)" + CODE + r"|[$€£¥]")
    row = F.col("pick").isNotNull() & money.nonzero(F.col("pick.amount")) & ~F.col("part") & ~taken & (F.col("total") | hint)
    df = df.withColumn("row", F.coalesce(row, F.lit(False)))
    parent = F.last(F.when(F.col("row"), F.struct("line_no", "pick.amount")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("parent", parent)
    good = lambda c: F.size(text.tokens(c)) >= 2
    bare = F.trim(F.regexp_replace("line", BARE, " "))
    one = text.once(bare, lambda c: F.when(~F.col("usable1"), c).when(good(c), c).otherwise(F.concat_ws(" ", "prev1", c)))
    two = text.once(one, lambda c: F.when(~F.col("usable1") | ~F.col("usable2"), c).when(good(c), c).otherwise(F.concat_ws(" ", F.col("prev2"), c)))
    df = fixed(df.where(F.col("row") | F.col("part")), described=F.left(text.spaced(two), F.lit(160)))
    described = F.col("described")
    echo = F.abs(F.col("pick.amount") - F.col("parent.amount")) <= 0.005
    source = F.when(F.col("part"), F.when(echo, "text_row|echo").otherwise("text_row|alloc_part")).otherwise(F.when(F.col("total"), "text_row_total").otherwise("text_row"))
    wanted = (F.col("row") & (good(described) | F.col("total"))) | (F.col("part") & F.col("pick").isNotNull() & F.col("parent").isNotNull())
    return df.where(wanted).select(*PAGE, "line_no", F.col("ends").alias("last_no"), described.alias("description"), "pick.currency", "pick.amount", source.alias("source"), F.when(F.col("part"), F.col("parent.line_no")).alias("parent_line"))


def amounts_in_context(lines: DataFrame, page: str = "SGD", window: int = 24, heard: int = 56) -> DataFrame:
    """(file, page, line_no, n, at, amount, currency, score, picked): every amount of a line with the currency named beside it.

    A currency directly behind the figure, in brackets or not, counts first, then one
    directly before it, with a colon or a hyphen between, both within ``window``
    characters; then what stands at the figure itself, then the page's. ``score`` rates the words in
    the ``heard`` characters on the left (``money.context_score``); a line's best is picked,
    of equals the one further right. Figures and what stands between them are
    rows, and neighbours come from windows over them, so a line costs a sort of its pieces.
    """
    parts = lines.select(*PAGE, "line_no", F.lit(page).alias("own"), F.posexplode(money.figure_parts(F.coalesce("line", F.lit("")))).alias("k", "part"))
    order = Window.partitionBy(*PAGE, "line_no").orderBy("k")
    near = F.collect_list("part").over(order.rowsBetween(-12, -1))
    before, behind = F.right(F.lag("part").over(order), F.lit(window)), F.left(F.lead("part").over(order), F.lit(window))
    parts = parts.withColumns({
        "at": F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.right(F.array_join(near, ""), F.lit(heard)),
        "after": F.upper(F.regexp_extract(behind, rf"(?i)^\s*\(?\s*({CODE})\b", 1)),
        "ahead": F.upper(F.regexp_extract(before, rf"(?i)\b({CODE})\s*[:\-]?\s*$", 1)),
    })
    found = parts.where((F.col("k") % 2 == 1) & money.counts(F.col("part")))
    currency = F.coalesce(text.null_if_empty(F.col("after")), text.null_if_empty(F.col("ahead")), money.token_currency(F.col("part"), F.col("own")))
    found = found.withColumns({"n": F.row_number().over(order) - 1, "amount": money.figure_value(F.col("part")), "currency": currency}).where("amount is not null")
    found = found.withColumn("score", money.context_score(F.col("left"), F.col("currency"), F.col("own"), F.col("at")))
    best = F.row_number().over(Window.partitionBy(*PAGE, "line_no").orderBy(F.desc("score"), F.desc("at")))
    return found.withColumn("picked", best == 1).select(*PAGE, "line_no", "n", "at", "amount", "currency", "score", "picked")


def header_table(lines: DataFrame, reach: int = 79, page: str = "SGD") -> DataFrame:
    """(file, page, line_no, description, currency, amount) of lines below a table's heading, up to its total row or ``reach`` lines.

    Columns are two blanks apart in the raw line; the first is the text, the last the amount.
    """
    marks = lines.select("*", F.inline(F.array(F.struct(predicates.is_table_header(F.col("line")).alias("head"), predicates.is_total_row(F.col("line")).alias("stop")))))
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    marks = marks.withColumn("at", F.last(F.when(F.col("head"), F.col("line_no")), ignorenulls=True).over(order))
    marks = marks.withColumn("ended", F.last(F.when(F.col("stop"), F.col("line_no")), ignorenulls=True).over(order))
    body = marks.where(~F.col("head") & ~F.col("stop") & (F.col("line_no") - F.col("at") <= reach) & (F.coalesce("ended", F.lit(-1)) < F.col("at")))
    pick = lambda cols: money.best_amount(F.col("line"), money.amounts(F.element_at(cols, -1), F.lit(page)), F.lit(page))
    cell = lambda cols, p: F.struct(text.spaced(F.get(cols, 0)).alias("description"), p["currency"].alias("currency"), p["amount"].alias("amount"))
    row = lambda cols: F.when(F.size(cols) >= 2, text.once(pick(cols), lambda p: F.when(p.isNotNull(), cell(cols, p))))
    return body.select(*PAGE, "line_no", kept(text.once(F.split(F.trim("line"), r"\s{2,}"), row)))


def page_routes(pages: DataFrame) -> DataFrame:
    """(file, page, origin, destination): each page's route, found on it, else on the page before, the next or the one after."""
    own = pages.select(*PAGE, F.posexplode(F.split("text", r"\R")).alias("n", "line")).where(F.col("line").rlike(r"(?i)\bfrom\b.+\bto\b|\bto\b.+\bfrom\b"))
    own = own.withColumn("r", text.route(F.col("line"))).where("r.origin <> '' and r.destination <> ''")
    own = own.groupBy(*PAGE).agg(F.min_by("r", "n").alias("r"))
    # A route found on page p serves p, p + 1, p - 1 and p - 2, in that order of preference.
    served = own.select("file", F.explode(F.arrays_zip(F.array(*[F.col("page") + d for d in (0, 1, -1, -2)]).alias("page"), F.array(*map(F.lit, range(4))).alias("rank"))).alias("s"), "r")
    best = served.groupBy("file", F.col("s.page").alias("page")).agg(F.min_by("r", "s.rank").alias("r"))
    return pages.select(*PAGE).join(best, PAGE, "left").select(*PAGE, "r.origin", "r.destination")


# Positioned words (file, page, x, y, word, ...)


def assemble_lines(words: DataFrame) -> DataFrame:
    """(file, page, block, par, line, text) from scanned words, in order of ``word_no``; blank words don't count."""
    kept = words.where(F.trim("word") != "")
    ordered = F.sort_array(F.collect_list(F.struct("word_no", "word")))
    return kept.groupBy(*PAGE, "block", "par", "line").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"))


def dominant_column(words: DataFrame, width: int = 10) -> DataFrame:
    """(file, page, x, n): the fullest stretch of x positions per page; of equals the leftmost."""
    counts = words.groupBy(*PAGE, (F.bround(F.col("x") / width) * width).alias("x")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*PAGE).agg(F.max(F.struct("n", -F.col("x"))).alias("b"))
    return best.select(*PAGE, (-F.col("b.col2")).alias("x"), "b.n")


def right_margin(gaps: DataFrame, least: float = 12.0, most: float = 28.0, usual: float = 24.0) -> DataFrame:
    """(file, page, margin): the lower quartile of gaps before amounts, between ``least`` and ``most``."""
    quartile = F.coalesce(F.percentile("gap", 0.25), F.lit(usual))
    return gaps.groupBy(*PAGE).agg(F.greatest(F.lit(least), F.least(F.lit(most), quartile)).alias("margin"))


def noise_words(words: DataFrame, share: float = 0.6) -> DataFrame:
    """(file, page, word): words of three letters or more on at least ``share`` of a page's lines."""
    n = words.groupBy(*PAGE).agg(F.count_distinct("line_no").alias("n_lines"))
    seen = words.withColumn("word", F.lower("word")).where(F.col("word").rlike("^[a-z]{3,}$")).groupBy(*PAGE, "word").agg(F.count_distinct("line_no").alias("n"))
    return seen.join(n, PAGE).where(F.col("n") >= share * F.col("n_lines")).select(*PAGE, "word", "n")


def vertical_groups(lines: DataFrame, gap: float = 20.0) -> DataFrame:
    """``lines`` (file, page, y, ...) with ``grp``: lines follow on while they are at most ``gap`` apart."""
    order = Window.partitionBy(*PAGE).orderBy("y", "line_no")
    new = F.coalesce((F.col("y") - F.lag("y").over(order) > gap).cast("int"), F.lit(0))
    return lines.withColumn("new", new).withColumn("grp", F.sum("new").over(order)).drop("new")


def _fullest(xs: Column, width: int = 10) -> Column:
    """:func:`dominant_column` of an array: the stretches are sorted and counted run by run."""
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x == acc["x"], acc["n"] + 1).otherwise(1)
        return text.once(n, lambda k: F.struct(x.alias("x"), k.alias("n"), F.when(k > acc["most"], x).otherwise(acc["best"]).alias("best"), F.greatest(k, acc["most"]).alias("most")))

    return F.aggregate(F.sort_array(F.transform(xs, lambda x: F.bround(x / width) * width)), start, step, lambda acc: acc["best"])


def _quartile(xs: Column) -> Column:
    """The lower quartile of a sorted array, as ``percentile`` has it."""
    at = (F.size(xs) - 1) * 0.25
    low, high = F.get(xs, F.floor(at).cast("int")), F.get(xs, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _often(words: Column, least: Column) -> Column:
    """The words that a sorted array has ``least`` times or more."""
    return F.array_distinct(F.filter(text.once(words, lambda ws: F.transform(ws, lambda w, i: F.when(F.get(ws, i + least - 1) == w, w))), lambda w: w.isNotNull()))


def _placed_lines(words: DataFrame, page: str, band: float) -> DataFrame:
    """(dealt, file, page, column, lines, gaps, noise) of pages with amounts: ``lines`` of (line_no, texts, a), ``a`` being a line's amount.

    Words are dealt once, by ``dealt``, a hash of the page; pages are put together where they
    then are, and their words, in order, are cut into lines, so each step costs a pass over them.
    """
    value = money.parse_amount(F.regexp_replace(F.regexp_extract("word", r"([(]?-?[0-9][0-9,]*\.[0-9]{2}[)]?)$", 1), ",", ""))
    value = F.when(F.contains("word", F.lit(".")) & F.col("word").rlike(rf"^{money.AT_FIGURE}?\(?-?[0-9][0-9,]*\.[0-9]{{2}}\)?$"), value)
    codes = F.array(*map(F.lit, money.ISO))
    named = F.when(F.length("word") == 3, F.nullif(F.array_position(codes, F.upper("word")), F.lit(0))).cast("int")
    page_, line_no = ["dealt", *PAGE], F.floor(F.col("y") / 2).cast("int").alias("line_no")
    df = words.where("word is not null").withColumn("dealt", F.xxhash64(*PAGE)).repartition("dealt").select(*page_, F.struct(line_no, "x", "word", value.alias("value"), named.alias("named")).alias("w"))
    df = df.groupBy(*page_).agg(F.sort_array(F.collect_list("w")).alias("ws"))
    starts = F.filter(F.transform("ws", lambda w, i: F.when((i == 0) | ~F.equal_null(F.get("ws", i - 1)["line_no"], w["line_no"]), i)), lambda i: i.isNotNull())
    df = df.select(*page_, "ws", F.explode(F.array(starts)).alias("starts"))

    def parts(ws: Column) -> Column:
        """A line of its words, from the left."""
        figure = lambda w, i: F.when(w["value"].isNotNull(), F.struct(w["x"].alias("x"), w["word"].alias("word"), w["value"].alias("value"), F.get(codes, F.get(ws, i - 1)["named"] - 1).alias("code")))
        return F.struct(
            F.get(ws, F.lit(0))["line_no"].alias("line_no"),
            F.array_min(ws["named"]).alias("code"),
            F.filter(F.transform(ws, figure), lambda w: w.isNotNull()).alias("figures"),
            # A currency alone is no text.
            F.filter(ws, lambda w: w["value"].isNull() & w["named"].isNull()).alias("texts"),
        )

    cut = F.transform("starts", lambda s, k: text.once(F.slice("ws", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ws")) - s), parts))
    df = df.select(*page_, F.explode(F.array(cut)).alias("ls"))
    own = F.coalesce(F.get(codes, F.array_min(F.col("ls")["code"]) - 1), F.lit(page))
    figures = F.flatten(F.transform("ls", lambda x: x["figures"]["x"]))
    # What a later step names often goes through an array of one row, so that it isn't worked out there again.
    df = df.select(*page_, "ls", F.inline(F.array(F.struct(_fullest(figures).alias("column"), own.alias("own"))))).where("column is not null")

    def amount(f: Column) -> Column:
        currency = F.coalesce(f["code"], money.token_currency(f["word"], F.col("own")))
        return text.once(currency, lambda c: F.struct((c == F.col("own")).alias("fits"), f["x"].alias("x"), f["value"].alias("value"), c.alias("currency")))

    near = lambda x: F.filter(x["figures"], lambda f: F.abs(f["x"] - F.col("column")) <= band)
    lines = F.transform("ls", lambda x: F.struct(x["line_no"].alias("line_no"), x["texts"].alias("texts"), F.array_max(F.transform(near(x), amount)).alias("a")))
    lines = F.filter(lines, lambda x: (F.size(x["texts"]) > 0) | x["a"].isNotNull())
    df = df.select(*page_, "column", F.explode(F.array(lines)).alias("lines"))
    gap = lambda x: x["a"]["x"] - F.array_max(F.filter(x["texts"]["x"], lambda at: at < x["a"]["x"]))
    placed = F.filter("lines", lambda x: x["a"].isNotNull() & (F.size(x["texts"]) > 0))

    def noisy(ls: Column) -> Column:
        said = F.flatten(F.transform(ls, lambda x: F.array_distinct(F.filter(F.transform(x["texts"]["word"], F.lower), lambda w: w.rlike("^[a-z]{3,}$")))))
        return _often(F.sort_array(said), F.ceil(F.size(ls) * 0.6).cast("int"))

    gaps = lambda ls: F.sort_array(F.filter(F.transform(ls, gap), lambda g: g.isNotNull()))
    df = df.select(*page_, "column", "lines", F.inline(F.array(text.once(placed, lambda ls: F.struct(gaps(ls).alias("gaps"), noisy(ls).alias("noise"))))))
    return df.where(F.size("gaps") > 0)


def layout_rows(words: DataFrame, page: str = "SGD", band: float = 15.0, gap: float = 20.0, down: int = 3, up: int = 2) -> DataFrame:
    """(file, page, line_no, description, currency, amount) of a table given as positioned words (x, y, word).

    Lines are two points high. The amount is the rightmost figure within ``band`` of the
    page's dominant column, one in the page's currency before any other; the text is what
    stands left of it by the page's margin, without the page's noise words. Up to
    ``down`` lines without an amount below it and then up to ``up`` above it belong to
    it, while lines are at most ``gap`` points apart and none is blank there, a heading or a total; a
    line that one row has read on to is not read by the next. Two telling words at least make a row.
    """
    line, place = ["dealt", *PAGE, "line_no"], ["dealt", *PAGE]  # rows stay where their page was dealt
    df = _placed_lines(words, page, band).withColumn("margin", F.greatest(F.lit(12.0), F.least(F.lit(28.0), _quartile(F.col("gaps")))))
    df = df.select(*place, "column", "margin", "noise", F.inline(F.filter("lines", lambda x: x["line_no"].isNotNull())))
    limit = F.coalesce("a.x", "column") - F.col("margin")
    left = F.filter("texts", lambda w: (w["x"] < limit) & ((F.size("noise") == 0) | ~F.array_contains("noise", F.lower(w["word"]))))
    whole = F.array_join(F.col("texts")["word"], " ")
    stop = text.once(whole, lambda w: predicates.is_table_header(w) | predicates.is_total_row(w))
    df = df.select(*line, F.col("a.currency").alias("currency"), F.col("a.value").alias("amount"), F.array_join(left["word"], " ").alias("text"), stop.alias("stop"))

    order = Window.partitionBy(*place).orderBy("line_no")
    steps = gap / 2
    df = df.withColumns({"at": F.row_number().over(order), "wide_above": F.col("line_no") - F.lag("line_no").over(order) > steps, "wide_below": F.lead("line_no").over(order) - F.col("line_no") > steps})
    closed = F.col("amount").isNotNull() | F.col("stop") | (F.col("text") == "")
    mark = lambda cut: F.when(cut, F.struct("at", "line_no", F.col("amount").isNotNull().alias("row")))
    ends = F.last(mark(closed | F.coalesce("wide_above", F.lit(True))), ignorenulls=True).over(order)
    df = df.withColumn("near", ends).withColumn("owner", F.when(F.col("near.row") & (F.col("at") > F.col("near.at")) & (F.col("at") - F.col("near.at") <= down), F.col("near.line_no")))
    # No row reaches further up than ``up`` lines, so none looks further down, and lines are sorted once.
    begins = F.first(mark(closed | F.coalesce("wide_below", F.lit(True)) | F.col("owner").isNotNull()), ignorenulls=True).over(order.rowsBetween(0, up))
    df = df.withColumn("near", begins).withColumn("owner", F.coalesce("owner", F.when(F.col("near.row") & (F.col("near.at") > F.col("at")) & (F.col("near.at") - F.col("at") <= up), F.col("near.line_no"))))
    df = df.withColumn("owner", F.when(F.col("amount").isNotNull(), F.col("line_no")).otherwise(F.col("owner"))).where("owner is not null")
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text"))))
    rows = df.groupBy(*place, F.col("owner").alias("line_no")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("description"), F.max("currency").alias("currency"), F.max("amount").alias("amount"))
    return rows.where(F.size(text.tokens(F.col("description"))) >= 2).select(*PAGE, "line_no", "description", "currency", "amount")


# Items


def claimed(found: DataFrame) -> DataFrame:
    """Of ``found`` (file, page, item, claim, line_no, last_no, ...) what is left when every line of a page serves one extractor.

    In the order of ``claim``, an item whose lines are all free, or taken by items of its
    own claim, takes them; any other is withheld and takes nothing. Items are dealt by page once a
    round, and each round is one table: an item whose lines no lower claim can still take wins, and those
    that share a line with a winner of another claim are withheld. Few items wait for a second round, and there are no more rounds than extractors.
    """
    waiting, kept = found, None
    of_line, of_item = Window.partitionBy(*PAGE, "taken"), Window.partitionBy(*PAGE, "item")
    while kept is None or not waiting.isEmpty():
        spread = waiting.repartition(*PAGE).withColumn("taken", F.explode(F.sequence("line_no", "last_no")))
        spread = spread.withColumn("top", F.min("claim").over(of_line)).withColumn("won", F.bool_and(F.col("claim") == F.col("top")).over(of_item))
        spread = spread.withColumn("by", F.min(F.when(F.col("won"), F.col("claim"))).over(of_line))
        spread = spread.withColumn("barred", F.coalesce(F.bool_or(F.col("by") != F.col("claim")).over(of_item), F.lit(False)))
        told = staged(spread.where(F.col("taken") == F.col("line_no")).where("won or not barred").select(*found.columns, "won"), "claims")
        won, waiting = told.where("won").drop("won"), told.where("not won").drop("won")
        kept = won if kept is None else kept.unionByName(won)
    return kept


def first_seen(items: DataFrame, place: list[str] | None = None) -> DataFrame:
    """Items without repeats of (amount, description) in a file, or in ``place``; the first emitted stays. ``nkey``, where there, is the description's key."""
    key = F.col("nkey") if "nkey" in items.columns else text.alike(F.col("description"))
    rank = F.row_number().over(Window.partitionBy(*(place or ["file"]), "cents", key).orderBy("emit_seq"))
    return items.withColumn("rank", rank).where("rank = 1").drop("rank")


def replicate_for_echoes(items: DataFrame) -> DataFrame:
    """Primary items as often as they have echoes, and once without any; ``parent_id`` ties an echo to its primary."""
    echoes = items.where("parent_id is not null").groupBy(F.col("parent_id").alias("item_id")).agg(F.count("*").alias("m"))
    primary = items.where("parent_id is null").join(echoes, "item_id", "left")
    return primary.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.coalesce("m", F.lit(1)), F.lit(1)).cast("long")))).drop("m")
