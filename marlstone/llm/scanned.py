"""Text of scanned pages: page furniture, words parted by line ends, misread characters, continuous paragraphs.

The lexicon is the corpus's own: counts of words that stand inside a line, where no line end can have cut them. A
symmetric-delete index over the lexicon (keyed by a form in which characters that scanners confuse coincide) yields the
candidates of every word; a weighted edit distance with confusion pairs ranks them, counts of neighbouring word pairs
settle what the distance leaves open. A word counts by the trust in its line: the scanner's confidence where the line
has one, so what stands only in doubtful lines is taken for a misreading sooner than what a born-digital line says.

Nothing depends on absolute counts: words are compared by ratios of their own counts, or by shares of the corpus.

Defined cases: rows repeated with one line_id count once (the smallest text stays); null text is a blank line of no
kind; a null document_version_id, page_no or line_no groups like any value; missing geometry leaves the title to tell
furniture; extra columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.lines import countable, line_key, squeeze
from marlstone.llm.repeated_lines import repeated_in_pages
from marlstone.operators.joins import salted
from marlstone.session import cut

# What a scanner prints, and what stood there.
CONFUSIONS = [
    ("c", "e"), ("1", "i"), ("1", "l"), ("i", "l"), ("l", "i"), ("|", "l"), ("@", "a"), ("f", "t"), ("0", "o"),
    ("o", "0"), ("5", "s"), ("6", "b"), ("8", "b"), ("b", "h"), ("6", "h"), ("q", "g"), ("9", "g"), ("2", "z"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("ii", "u"), ("1i", "u"), ("i1", "u"), ("11", "u"), ("n", "ri"), ("d", "cl"), ("cl", "d"), ("rm", "nn"),
]
CONFUSED_COST = 0.25
# Page number forms in the languages of the pages.
PAGE_WORDS = "page|pag|pág|p|seite|página|ukurasa"
OF_WORDS = "of|/|de|von|sur|ya"
HYPHENS = "-­¬‐‑"
#: A word is taken for a misreading of another only if the other is this many times as frequent.
RATIO = 8
#: Trust, in hundredths, in a scanned line without a confidence, and the least trust in any line.
SCANNED_TRUST, LEAST_TRUST = 80, 25
#: Share of all words up to which (or up to FEW of them, however small the corpus) a figure with confused letters is read as
#: a number though no such number is known, and share from which on two words in a row can be one word that lost its
#: hyphen at the line's end.
RARE, FEW, COMMON = 3e-5, 3, 5e-5
#: Forms longer than this meet on thirds of their length, of which two edits leave one whole, instead of on deletions.
LONG = 24
#: Cells this far off the diagonal of the distance cost more than any accepted reading.
BAND = 8
#: Share of a body line's height below which a line beyond the body or in the margin counts as small print.
SMALL = 0.9
#: Height of a page in points, and the share of it at top and bottom that is margin.
PAGE_HEIGHT = 842.0
MARGIN_ZONE = 0.1

_DIGITISH = "[0-9liosbzgq|]"
_PAGE_NUMBER = (
    rf"^[-–—\[(|. ]*(?:(?:{PAGE_WORDS})[. ]*)?(?:[ivxlc]{{1,7}}|{_DIGITISH}{{1,4}}(?: ?(?:{OF_WORDS}) ?{_DIGITISH}{{1,4}})?)[-–—\])|. ]*$"
)


def trust(from_ocr: Column, confidence: Column) -> Column:
    """Hundredths by which a line's words count: its confidence if that is possible, else SCANNED_TRUST on a scan and 100 off it."""
    known = F.when((confidence >= 0) & (confidence <= 1), F.round(confidence * 100))
    return F.greatest(F.coalesce(known, F.when(from_ocr, F.lit(SCANNED_TRUST)), F.lit(100)).cast("bigint"), F.lit(LEAST_TRUST).cast("bigint"))


def page_lines(text_line: DataFrame, document_version: DataFrame) -> DataFrame:
    """One row per line_id with kind (running_header, page_number or null), the line's key and its place on the page.

    Furniture lies above or below the body of its page and is set smaller than the document's usual line, or says what
    the title says. Windows are over single pages, never over a document or a source.
    """
    height = F.col("bbox_bottom") - F.col("bbox_top")
    lines = text_line.select(
        "line_id", "document_version_id", "source", "page_no", "line_no", "text", "bbox_top", "bbox_bottom",
        height.alias("height"), trust(F.col("from_ocr"), F.col("confidence")).alias("trust"),
    )
    usual = lines.groupBy("document_version_id").agg(F.percentile_approx("height", 0.5).alias("usual"))
    versions = document_version.groupBy("document_version_id").agg(
        F.min("title").alias("title"),
        F.to_date(F.min(F.coalesce(F.col("effective_date").cast("timestamp"), F.col("ingested_at").cast("timestamp")))).alias("day"),
    )
    about = usual.join(versions, "document_version_id", "left")
    page = Window.partitionBy("document_version_id", "page_no")
    order = page.orderBy("line_no", "line_id", "text")
    ends = F.row_number().over(order)
    full = F.col("height") >= F.col("usual") * 0.92
    tight = squeeze(F.lower("text"))
    bare = F.regexp_replace(F.regexp_replace(tight, r"^\d+ ?\| ?", ""), r" ?\d+$", "")
    title = squeeze(F.lower("title"))
    placed = (
        lines.join(about, lines.document_version_id.eqNullSafe(about.document_version_id), "left")
        .drop(about.document_version_id)
        .withColumn("_again", F.lag("line_id").over(order).eqNullSafe(F.col("line_id")) & F.col("line_id").isNotNull())
        .where("not _again")
        .withColumn("_top", F.min(F.when(full, F.col("bbox_top"))).over(page))
        .withColumn("_bottom", F.max(F.when(full, F.col("bbox_bottom"))).over(page))
        .withColumn("_edge", (ends == 1) | (F.lead("line_id").over(order).isNull()))
    )
    beyond = F.coalesce(
        (F.col("bbox_bottom") <= F.col("_top") + 0.5) | (F.col("bbox_top") >= F.col("_bottom") - 0.5),
        F.when(F.col("height").isNotNull(), F.lit(True)).otherwise(F.col("_edge")),
    )
    margin = (F.col("bbox_top") <= PAGE_HEIGHT * MARGIN_ZONE) | (F.col("bbox_bottom") >= PAGE_HEIGHT * (1 - MARGIN_ZONE))
    small = F.coalesce(F.col("height") < F.col("usual") * SMALL, F.lit(False))
    unmeasured = F.col("height").isNull()
    named = F.coalesce(F.levenshtein(bare, title) <= F.length(title) * 0.15, F.lit(False))
    is_number = F.coalesce(tight.rlike(_PAGE_NUMBER), F.lit(False))
    kind = (
        F.when(((beyond | margin) & small | beyond & unmeasured) & is_number, "page_number")
        .when((beyond | margin) & small & tight.rlike(r"\p{L}") | beyond & named, "running_header")
        .otherwise(F.lit(None).cast("string"))
    )
    norm = F.coalesce(line_key(F.col("text")), F.lit(""))
    return placed.select(
        "line_id", "document_version_id", "source", "page_no", "line_no", "text", "bbox_top", "height", "usual", "day", "trust",
        kind.alias("kind"),
        F.xxhash64(norm).alias("norm_key"),
        (countable(norm)).alias("counts"),
        (norm != "").alias("filled"),
    )


def site_lines(pages: DataFrame) -> DataFrame:
    """source, key of the lines repeated within a source over its document versions (small, see repeated_lines)."""
    return cut(repeated_in_pages(pages).select("source", "key"))


def body_lines(pages: DataFrame, site: DataFrame) -> DataFrame:
    """Lines that are neither furniture nor site lines nor blank, with single blanks, their words, the words' cores (computed
    once, read by every later step) and the first word of the next body line.

    The next line is looked up within the page; a page's last line takes the first line of the next page with a body,
    by a window over one row a page.
    """
    known = site.select("source", F.col("key").alias("norm_key"))
    body = salted(pages.where(F.col("kind").isNull() & F.col("filled")), known, ["source", "norm_key"], ["line_id"], "left_anti")
    order = Window.partitionBy("document_version_id", "page_no").orderBy("line_no", "line_id")
    body = body.withColumn("text", squeeze(F.col("text"))).withColumn("first", F.substring_index("text", " ", 1))
    body = (
        body.withColumn("nth", F.row_number().over(order))
        .withColumn("in_page_next", F.lead("first").over(order))
        .withColumn("in_page_next_id", F.lead("line_id").over(order))
    )
    heads = body.where("nth = 1").select("document_version_id", "page_no", "first", "line_id")
    along = Window.partitionBy("document_version_id").orderBy("page_no")
    heads = heads.select(
        "document_version_id",
        "page_no",
        F.lead("first").over(along).alias("over_next"),
        F.lead("line_id").over(along).alias("over_next_id"),
    )
    same = body.document_version_id.eqNullSafe(heads.document_version_id) & body.page_no.eqNullSafe(heads.page_no)
    joined = body.join(heads, same, "left").drop(heads.document_version_id).drop(heads.page_no)
    return joined.withColumn("words", F.split("text", " ")).select(
        "line_id", "document_version_id", "page_no", "line_no", "text", "words", F.transform("words", core).alias("cores"),
        "bbox_top", "height", "usual", "trust",
        F.coalesce("in_page_next", "over_next").alias("next_word"),
        F.coalesce("in_page_next_id", "over_next_id").alias("next_id"),
        F.col("in_page_next").isNull().alias("ends_page"),
        (F.col("nth") == 1).alias("starts_page"),
    )


def core(word: Column) -> Column:
    """A word in lower case without the marks around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@%]+$", "")


def fold(word: Column) -> Column:
    """The form in which characters that scanners confuse coincide."""
    out = F.translate(word, "1i|0@et568hq92", "llloacfsbbbggz")
    for found, put in (("vv", "w"), ("rn", "m"), ("rl", "n"), ("cl", "d"), ("nn", "rm"), ("rn", "m")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def forms(word: Column) -> Column:
    """A word's folded form, and the one in which two strokes are a u."""
    return F.array_distinct(F.array(fold(word), fold(F.regexp_replace(word, "[i1][i1]", "u"))))


def lexicon(body: DataFrame) -> DataFrame:
    """word, n: how often a word stands inside a line, neither first nor last, each time by the line's trust."""
    inner = F.slice("cores", 2, F.greatest(F.size("cores") - 2, F.lit(0)))
    return (
        body.select("trust", F.explode(inner).alias("word"))
        .where("word != ''")
        .groupBy("word")
        .agg((F.sum("trust") / 100).alias("n"))
    )


def pair_counts(body: DataFrame) -> DataFrame:
    """left_word, right_word, n of neighbours inside a line."""
    left = F.slice("cores", 2, F.size("cores") - 3)
    right = F.slice("cores", 3, F.size("cores") - 3)
    return (
        body.where(F.size("cores") >= 4)
        .select(F.inline(F.arrays_zip(left.alias("left_word"), right.alias("right_word"))))
        .groupBy("left_word", "right_word")
        .agg(F.count("*").alias("n"))
    )


def line_ends(body: DataFrame, words: DataFrame, pairs: DataFrame, n_words: float) -> DataFrame:
    """line_id, next_id, joint ('' a word cut by the line end, '-' a compound parted at its own hyphen), joined word.

    A hyphen at the end is a cut if the lexicon knows the whole without a hyphen at least as well as with one; where it
    knows neither, unless both parts are words. Without a hyphen (the scanner lost it) a cut needs a known whole, a part
    that is no word or far rarer than the whole, and hardly any such pair inside lines; if both are words, the whole must
    be a common one of the n_words of the corpus.
    """
    last = F.element_at("words", -1)
    hyphened = last.rlike(rf"[\p{{L}}\p{{N}}@][{HYPHENS}]$")
    bare_end = last.rlike(r"[\p{L}@0-9]$") & F.col("next_word").rlike(r"^[\p{Ll}@0-9]") & last.rlike(r"\p{Ll}")
    ends = (
        body.where(F.col("next_word").isNotNull() & (hyphened | bare_end))
        .select("line_id", "next_id", hyphened.alias("hyphened"), F.element_at("cores", -1).alias("a"), core(F.col("next_word")).alias("b"),
                last.rlike("[­¬‐‑]$").alias("soft"))
        .where("a != '' and b != '' and b rlike '^[\\\\p{L}@0-9]'")
    )
    asked = ends.select("a", "b", "hyphened", "soft").distinct()
    folded = words.groupBy(fold(F.col("word")).alias("key")).agg(F.sum("n").alias("n"))

    def counted(df: DataFrame, value: Column, name: str, exact: bool = False) -> DataFrame:
        if exact:
            return df.join(words.select(F.col("word").alias(f"_{name}"), F.col("n").alias(name)), value == F.col(f"_{name}"), "left").drop(f"_{name}")
        return df.join(folded.select(F.col("key").alias(f"_{name}"), F.col("n").alias(name)), fold(value) == F.col(f"_{name}"), "left").drop(f"_{name}")

    a, b = F.col("a"), F.col("b")
    found = counted(asked, F.concat(a, b), "n_whole")
    found = counted(found, F.concat_ws("-", a, b), "n_compound")
    found = counted(found, a, "n_a", exact=True)
    found = counted(found, b, "n_b", exact=True)
    found = found.join(pairs.select(F.col("left_word").alias("a"), F.col("right_word").alias("b"), F.col("n").alias("n_pair")), ["a", "b"], "left")
    found = found.fillna(0, ["n_whole", "n_compound", "n_a", "n_b", "n_pair"])
    whole, compound = F.col("n_whole"), F.col("n_compound")
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    joint = F.when(
        F.col("hyphened"),
        F.when((whole > 0) & (whole >= compound), "").when(compound > 0, "-").when(both & ~F.col("soft"), "-").otherwise(""),
    ).when(
        (F.col("n_pair") * 20 < whole) & (F.least("n_a", "n_b") * 20 < whole)
        & F.when(both, (F.col("n_pair") == 0) & (whole >= COMMON * n_words)).otherwise(F.lit(True)), ""
    )
    decided = found.withColumn("joint", joint).where("joint is not null").select("a", "b", "hyphened", "soft", "joint")
    return ends.join(decided, ["a", "b", "hyphened", "soft"]).select(
        "line_id", "next_id", "joint", "a", "b", F.concat("a", "joint", "b").alias("joined")
    )


def checked_words(body: DataFrame, ends: DataFrame) -> DataFrame:
    """line_id, trust, pos, word, left_word, right_word, second_id, a, b: every word to look up, parts of a joined word as one."""
    own = ends.select("line_id", "joint", "joined", F.col("next_id").alias("second_id"), "a", "b")
    before = ends.select(F.col("next_id").alias("line_id"), F.lit(True).alias("continues")).distinct()
    lines = body.join(own, "line_id", "left").join(before, "line_id", "left")
    first = F.when(F.col("continues"), 2).otherwise(1)
    last = F.size("words") - F.when(F.col("joint").isNotNull(), 1).otherwise(0)
    none = F.lit(None).cast("string")
    singles = F.when(
        last >= first,
        F.transform(
            F.sequence(first, last),
            lambda i: F.struct(
                i.alias("pos"), F.element_at("cores", i).alias("word"),
                F.when(i > 1, F.element_at("cores", F.greatest(i - 1, F.lit(1)))).alias("left_word"),
                F.when(i < F.size("cores"), F.element_at("cores", F.least(i + 1, F.size("cores")))).alias("right_word"),
            ),
        ),
    )
    alone = lines.select("line_id", "trust", F.inline(singles)).select(
        "line_id", "trust", "pos", "word", "left_word", "right_word", F.lit(None).cast("bigint").alias("second_id"), none.alias("a"), none.alias("b")
    )
    both = lines.where("joint is not null").select(
        "line_id", "trust", F.size("words").alias("pos"), F.col("joined").alias("word"),
        F.when(F.size("cores") > 1, F.element_at("cores", F.greatest(F.size("cores") - 1, F.lit(1)))).alias("left_word"),
        none.alias("right_word"), "second_id", "a", "b",
    )
    return alone.unionByName(both).where("word != ''")


@F.pandas_udf(T.DoubleType())
def _distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for printed, meant in pairs:
        yield pd.Series([weighted_distance(a, b) for a, b in zip(printed, meant, strict=True)], dtype="float64")


_BY_LAST: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_LAST.setdefault((_a[-1], _b[-1]), []).append((_a, _b))


def weighted_distance(printed: str, meant: str) -> float:
    """Edit distance in which a listed confusion costs CONFUSED_COST and any other edit 1, within BAND of the diagonal."""
    n, m = len(printed), len(meant)
    far = float(n + m + 1)
    rows: list[dict[int, float]] = []
    for i in range(n + 1):
        row: dict[int, float] = {}
        above = rows[i - 1] if i else {}
        for j in range(max(0, i - BAND), min(m, i + BAND) + 1):
            best = 0.0 if i == j == 0 else far
            if i:
                best = min(best, above.get(j, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + 1)
            if i and j:
                best = min(best, above.get(j - 1, far) + (printed[i - 1] != meant[j - 1]))
                for a, b in _BY_LAST.get((printed[i - 1], meant[j - 1]), ()):
                    if i >= len(a) and j >= len(b) and printed.startswith(a, i - len(a)) and meant.startswith(b, j - len(b)):
                        best = min(best, rows[i - len(a)].get(j - len(b), far) + CONFUSED_COST)
            row[j] = best
        rows.append(row)
    return rows[n].get(m, far)


def _deletes(key: Column) -> Column:
    """A key and what is left of it after one deletion, or two of a longer key; none of a long one."""
    places = F.sequence(F.lit(1), F.length(key))

    def without(k: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substr(k, F.lit(1), i - 1), F.substr(k, i + 1))
        )

    one = F.transform(places, lambda i: F.concat(F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1)))
    two = F.flatten(F.transform(one, without))
    return F.array_distinct(
        F.when(F.length(key) > LONG + 2, F.array().cast("array<string>"))
        .when(F.length(key) >= 7, F.concat(F.array(key), one, two)).when(F.length(key) >= 4, F.concat(F.array(key), one)).otherwise(F.array(key))
    )


def _third(key: Column, length: Column, i: Column, shift: Column) -> Column:
    """The i-th third of a form of `length` characters, read from key so many characters further on, as text."""
    start, end = F.floor(length * i / 3).cast("int"), F.floor(length * (i + 1) / 3).cast("int")
    inside = (start + shift >= 0) & (end + shift <= F.length(key))
    return F.when(inside, F.concat_ws("|", i, length, F.xxhash64(F.substr(key, start + shift + 1, end - start)).cast("string")))


def _run(low: int, high: int) -> Column:
    return F.sequence(F.lit(low), F.lit(high))


def _known_keys(key: Column) -> Column:
    """Keys under which the lexicon holds a form: its deletions, or the thirds of a long one."""
    thirds = F.transform(_run(0, 2), lambda i: _third(key, F.length(key), i, F.lit(0)))
    return F.concat(_deletes(key), F.when(F.length(key) > LONG, thirds).otherwise(F.array().cast("array<string>")))


def _asked_keys(key: Column) -> Column:
    """Keys by which a form asks: its deletions, and the thirds of any long form two edits away, wherever edits put them."""
    moved = lambda d, i: F.transform(_run(-2, 2), lambda shift: _third(key, F.length(key) + d, i, shift))
    thirds = F.flatten(F.transform(_run(-2, 2), lambda d: F.flatten(F.transform(_run(0, 2), lambda i: moved(d, i)))))
    probed = F.filter(F.array_distinct(thirds), lambda k: k.isNotNull())
    return F.concat(_deletes(key), F.when(F.length(key) > LONG - 2, probed).otherwise(F.array().cast("array<string>")))


def corrections(asked: DataFrame, words: DataFrame, n_words: float) -> DataFrame:
    """word, candidate, cost, n: readings of each distinct asked word that is likely misread, from the symmetric-delete index.

    asked: word, n_asked. A candidate must be RATIO times as frequent as the word (as frequent, if the word has a figure
    or @ among its letters) and within a cost that grows with the word's length. Numbers with confused letters (2l, 3b19)
    are read as numbers, unless more than RARE of the corpus's n_words are like that or knows them as part of a compound.
    """
    lettered = r"\p{L}"
    odd = rf"^(?=.*[0-9])(?=.*[a-z|])[0-9liosbzgq|]+(?:[.,/][0-9liosbzgq|]+)*%?$"
    asks = asked.where(F.col("word").rlike(r"[\p{L}@|]")).withColumn("odd", F.col("word").rlike(odd))
    # Letters alone that scanners put for 1 and 0.
    ones = ["l", "ll", "lo", "ol", "lol", "llo", "loo"]
    limit = F.least(F.greatest(F.lit(2 * CONFUSED_COST), F.length("candidate") * 0.12), F.lit(1.5))
    # A figure or @ among letters tells a misreading by itself, however rare the word is.
    marked = F.col("word").rlike(r"\p{L}[0-9@|]+\p{L}|^@\p{L}|\p{L}@$")
    asked_keys = asks.where(~F.col("odd")).select("word", "n_asked", marked.alias("marked"), F.explode(forms(F.col("word"))).alias("form"))
    known_keys = cut(
        words.where(F.col("word").rlike(lettered) & ~F.col("word").rlike(odd) & (F.length("word") >= 2)).select(
            F.col("word").alias("candidate"), "n", F.explode(forms(F.col("word"))).alias("known_form")
        )
    )
    ratio = F.when(F.col("marked") & ~F.col("candidate").rlike("[0-9@|]"), 1).otherwise(RATIO)
    # Words of two letters differ from too many others: only a figure or mark in them tells a misreading.
    long_enough = (F.length("candidate") > 2) | F.col("word").rlike("[0-9@|]")
    better = (F.col("word") != F.col("candidate")) & (F.col("n") >= F.col("n_asked") * ratio) & long_enough

    def within(pairs: DataFrame) -> DataFrame:
        return pairs.select("word", "candidate", "n").withColumn("cost", _distance("word", "candidate")).where(F.col("cost") <= limit)

    # Most misreadings differ by listed confusions alone: an equal form finds them without the index.
    same_form = cut(within(asked_keys.join(known_keys, F.col("form") == F.col("known_form")).where(better).select("word", "candidate", "n").distinct()))
    rest = asked_keys.join(same_form.select("word").distinct(), "word", "left_anti").withColumn("key", F.explode(_asked_keys(F.col("form"))))
    index = known_keys.where(F.length("candidate") > 2)
    # A word counts LEAST_TRUST at least, so rarer candidates than that times RATIO can only serve marked words.
    common = F.col("n") >= RATIO * LEAST_TRUST / 100
    indexed = lambda df: df.withColumn("key", F.explode(_known_keys(F.col("known_form"))))
    by_key = rest.join(indexed(index.where(common)), "key").unionByName(rest.where("marked").join(indexed(index.where(~common)), "key"))
    edits = F.levenshtein("form", "known_form", 2)
    close = by_key.where(better & (edits >= 0) & (edits <= F.when(F.length("candidate") >= 9, 2).otherwise(1)))
    near = same_form.unionByName(within(close.select("word", "candidate", "n").distinct()))
    # A reading that is itself misread is none.
    near = near.join(near.select(F.col("word").alias("candidate")).distinct(), "candidate", "left_anti")
    number = F.translate("word", "lio|sbzgq", "110156299")
    numbers = asks.where(F.col("odd") | F.col("word").isin(ones)).select("word", "n_asked", number.alias("candidate"))
    parts = words.where(F.col("word").contains("-")).select("n", F.explode(F.split("word", "-")).alias("word")).groupBy("word").agg(F.sum("n").alias("n_part"))
    known = numbers.join(words.select(F.col("word").alias("candidate"), "n"), "candidate", "left").join(parts, "word", "left")
    often = F.coalesce(F.col("n"), F.lit(0.0)) >= F.col("n_asked") * RATIO
    free = ~F.col("word").isin(ones) & (F.col("n_asked") <= max(FEW, RARE * n_words)) & (F.coalesce("n_part", F.lit(0.0)) < F.col("n_asked"))
    read = known.where(often | free).select("word", "candidate", F.coalesce(F.col("n"), F.lit(1.0)).alias("n"), F.lit(CONFUSED_COST).alias("cost"))
    return near.select("word", "candidate", "n", "cost").unionByName(read)


def repairs(words_at: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """line_id, pos, word, candidate, second_id, a, b: each misread occurrence with the reading picked.

    A lower cost wins unless the neighbours speak for another candidate: the score adds the logarithms of the
    candidate's count and of its pairs with the word before and after, and takes off the cost.
    """
    at = words_at.join(candidates, "word")
    lefts = pairs.select("left_word", F.col("right_word").alias("candidate"), F.col("n").alias("n_left"))
    rights = pairs.select(F.col("left_word").alias("candidate"), "right_word", F.col("n").alias("n_right"))
    scored = (
        at.join(lefts, ["left_word", "candidate"], "left")
        .join(rights, ["candidate", "right_word"], "left")
        .withColumn(
            "score",
            F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0))) + 0.5 * F.log1p("n") - 8 * F.col("cost"),
        )
    )
    best = F.max(F.struct("score", "candidate"))
    return (
        scored.groupBy("line_id", "pos", "word", "second_id", "a", "b")
        .agg(best.alias("best"))
        .select("line_id", "pos", "word", F.col("best.candidate").alias("candidate"), "second_id", "a", "b")
    )


def misread_lines(repaired: DataFrame) -> DataFrame:
    """line_id of lines with a wrongly recognised character; of a joined word, the part that differs says which line."""
    in_second = F.col("second_id").isNotNull() & F.col("candidate").startswith(F.col("a"))
    in_first = F.col("second_id").isNull() | ~F.col("candidate").startswith(F.col("a"))
    both = F.col("second_id").isNotNull() & in_first & ~F.col("candidate").endswith(F.col("b"))
    firsts = repaired.where(in_first).select("line_id")
    seconds = repaired.where(in_second | both).select(F.col("second_id").alias("line_id"))
    return firsts.unionByName(seconds).distinct()


class Scan:
    """The steps over one pair of tables, each written once and shared by the results."""

    def __init__(self, text_line: DataFrame, document_version: DataFrame) -> None:
        self.pages = cut(page_lines(text_line, document_version))
        self.site = site_lines(self.pages)
        self.body = cut(body_lines(self.pages, self.site))
        self.words = cut(lexicon(self.body))
        self.pairs = cut(pair_counts(self.body))
        n_words = self.words.agg(F.sum("n")).first()[0] or 0.0  # one number
        self.ends = cut(line_ends(self.body, self.words, self.pairs, n_words))
        self.at = checked_words(self.body, self.ends)
        asked = cut(self.at.groupBy("word").agg((F.sum("trust") / 100).alias("n_asked")))
        self.candidates = cut(corrections(asked, self.words, n_words))
        self.repaired = cut(repairs(self.at, self.candidates, self.pairs))

    def found(self) -> DataFrame:
        """line_id, kind: furniture without site lines, cut words and misread lines."""
        site = self.site.select("source", F.col("key").alias("norm_key"))
        furniture = salted(self.pages.where("kind is not null"), site, ["source", "norm_key"], ["line_id"], "left_anti").select("line_id", "kind")
        cuts = self.ends.where("joint = ''").select("line_id", F.lit("hyphen_break").alias("kind"))
        misread = misread_lines(self.repaired).select("line_id", F.lit("misread").alias("kind"))
        return furniture.unionByName(cuts).unionByName(misread).where("line_id is not null").distinct()

    def paragraphs(self) -> DataFrame:
        """document_version_id, page_no, line_no, text: continuous paragraphs of the body, by the place of their first line.

        Misread words are replaced, words parted by line ends are whole again, furniture and site lines are gone. A
        heading, a bullet or a wider gap starts a paragraph; a page's first line goes on with the last paragraph unless
        that ended a sentence.
        """
        return paragraphs(repaired_lines(self.body, self.ends, self.repaired))


def _dressed(raw: Column, bare: Column) -> Column:
    """A repaired word with the marks and the capital of the raw one."""
    before = F.regexp_extract(raw, r"^[^\p{L}\p{N}@]*", 0)
    after = F.regexp_extract(raw, r"[^\p{L}\p{N}@%]*$", 0)
    capital = F.concat(F.upper(F.substr(bare, F.lit(1), F.lit(1))), F.substr(bare, F.lit(2)))
    return F.concat(before, F.when(raw.rlike(r"^[^\p{L}\p{N}]*\p{Lu}"), capital).otherwise(bare), after)


def repaired_lines(body: DataFrame, ends: DataFrame, repaired: DataFrame) -> DataFrame:
    """body with column fixed: the line's words after repair; a joined word stays whole in the line where it begins."""
    by_line = repaired.groupBy("line_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "candidate"))).alias("readings")
    )
    own = ends.select("line_id", "joint").dropDuplicates(["line_id"])
    before = ends.select(F.col("next_id").alias("line_id"), F.lit(True).alias("continues")).distinct()
    lines = body.join(by_line, "line_id", "left").join(own, "line_id", "left").join(before, "line_id", "left")
    size = F.size("words")
    stem = F.regexp_replace(F.element_at("words", -1), rf"[{HYPHENS}]$", "")

    def word(raw: Column, i: Column) -> Column:
        reading = F.element_at("readings", i + 1)
        whole = F.concat(stem, "joint", "next_word")
        ends_here = F.col("joint").isNotNull() & (i + 1 == size)
        mended = F.coalesce(F.when(ends_here, _dressed(whole, reading)).otherwise(_dressed(raw, reading)))
        kept = F.when(ends_here, whole).otherwise(raw)
        return F.when(F.col("readings").isNotNull() & reading.isNotNull(), mended).otherwise(kept)

    fixed = F.transform("words", word)
    fixed = F.when(F.col("continues"), F.slice(fixed, 2, size)).otherwise(fixed)
    return lines.withColumn("fixed", F.array_join(fixed, " ")).drop("readings", "joint", "continues")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Joins repaired lines into paragraphs; see Scan.paragraphs."""
    page = Window.partitionBy("document_version_id", "page_no")
    order = page.orderBy("line_no", "line_id")
    heading = F.coalesce(F.col("height") > F.col("usual") * 1.15, F.lit(False))
    lines = (
        lines.withColumn("heading", heading)
        .withColumn("gap", F.col("bbox_top") - F.lag("bbox_top").over(order))
        .withColumn("step", F.percentile_approx("gap", 0.5).over(page))
        .withColumn("prior", F.lag("text").over(order))
        .withColumn("prior_heading", F.lag("heading").over(order))
    )
    along = Window.partitionBy("document_version_id").orderBy("page_no")
    tails = lines.groupBy("document_version_id", "page_no").agg(
        F.max_by(F.struct("text", "heading"), F.struct("line_no", "line_id")).alias("tail")
    )
    tails = tails.withColumn("before", F.lag("tail").over(along)).drop("tail")

    def by_page(df: DataFrame, other: DataFrame) -> DataFrame:
        same = df.document_version_id.eqNullSafe(other.document_version_id) & df.page_no.eqNullSafe(other.page_no)
        return df.join(other, same, "left").drop(other.document_version_id).drop(other.page_no)

    lines = by_page(lines, tails)
    prior = F.coalesce("prior", "before.text")
    prior_heading = F.coalesce("prior_heading", "before.heading")
    closed = prior.rlike(r"[.!?:;]\s*$")
    starts = (
        prior.isNull() | F.col("heading") | prior_heading | F.col("text").rlike(r"^\s*[•▪*–-]\s")
        | F.coalesce(F.col("gap") > F.col("step") * 1.25, F.lit(False)) | (F.col("prior").isNull() & closed)
        | (F.col("bbox_top").isNull() & closed & (F.length(prior) < 45))
    )
    place = F.when(starts, F.struct("page_no", "line_no", "line_id"))
    lines = lines.withColumn("place", place).withColumn("start", F.last("place", ignorenulls=True).over(order))
    opened = lines.groupBy("document_version_id", "page_no").agg(F.max("place").alias("opened"))
    carried = F.last("opened", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    lines = by_page(lines, opened.withColumn("carried", carried).drop("opened"))
    lines = lines.withColumn("start", F.coalesce("start", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line_id", "fixed")))
    return (
        lines.groupBy("document_version_id", "start")
        .agg(parts.alias("parts"))
        .select(
            "document_version_id",
            F.col("start.page_no").alias("page_no"),
            F.col("start.line_no").alias("line_no"),
            F.array_join(F.filter(F.col("parts.fixed"), lambda t: t != ""), " ").alias("text"),
        )
        .where("text != ''")
    )
