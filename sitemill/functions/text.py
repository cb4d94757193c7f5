"""Text expressions: tokens, shingles, containment, marker alignment, tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no content.
STOPWORDS = (
    "a an the and or of for to in on at by with from as is are was were be been that this these those it its we our their his her they he she "
    "which who not but if then than so such can may might will would should could"
).split()
MARKERS = "TARGETCIT|OTHERCIT"
TARGET, OTHER = "TARGETCIT", "OTHERCIT"
MAX_REFERENCE = 1000
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = r"et al|Fig|Figs|Eq|Eqs|Sec|Secs|Ref|Refs|Tab|e\.g|i\.e|cf|vs|resp|approx|No|Dr|Prof"


def tokens_alpha(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def tokens_alnum(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def content_words(text: Column) -> Column:
    """Distinct words that aren't stopwords."""
    return F.array_except(F.array_distinct(tokens_alpha(text)), F.array(*map(F.lit, STOPWORDS)))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside other lambdas an expression would be computed again for each element."""
    return F.transform(F.array(value), f)[0]


def shingles(text: Column, n: int) -> Column:
    """Distinct runs of n words; none of a text of fewer."""
    return let(tokens_alpha(text), lambda w: _runs(w, n))


def _runs(w: Column, n: int) -> Column:
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return ratio(both, F.size(F.array_union(a, b)))


def containment(window: Column, title: Column) -> Column:
    """Share of the title's content words that are in the window; 0 if either has none."""
    a, b = content_words(window), content_words(title)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio(F.size(F.array_intersect(a, b)), F.size(b)))


def surname(author: Column) -> Column:
    """Last word in lower case; empty if there is none."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(author, F.lit("")), r"^\s+|\s+$", ""), r"\s+"), -1))


def is_easy(window: Column, title: Column, authors: Column, tau: float) -> Column:
    """The first author's surname is in the window, or the share of the title that is reaches tau. authors may be null."""
    name = surname(F.get(authors, 0))
    return F.coalesce((name != "") & F.array_contains(content_words(window), name), F.lit(False)) | (containment(window, title) >= tau)


def plausible(number: Column) -> Column:
    return F.coalesce(number.rlike("^[0-9]+$") & (number.try_cast("bigint") <= MAX_REFERENCE), F.lit(False))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markers_with_numbers(raw: Column, masked: Column) -> Column:
    """Array of (kind, num) by walking the text between markers through raw; null where it can't be aligned.

    Segments are looked for literally, one after another; the numbers in the gap before a segment must be as
    many as the markers that wait. Empty segments are passed over. The walk is one fold over the segments."""
    parts = F.split(masked, MARKERS, -1)
    kinds = F.regexp_extract_all(masked, F.lit(f"({MARKERS})"), 1)
    none = F.array().cast("array<struct<kind:string,num:string>>")
    start = F.struct(F.lit(True).alias("ok"), F.lit(1).alias("pos"), F.lit(0).alias("seen"), F.lit(0).alias("used"), none.alias("out"))

    def pair(a, frm, to, nums):
        wait = F.slice(kinds, frm + 1, to - frm)
        return F.zip_with(wait, nums, lambda k, n: F.struct(k.alias("kind"), n.alias("num")))

    def numbers(s):
        return F.regexp_extract_all(s, F.lit("([0-9]+)"), 1)

    def step(a, seg):
        s = _strip(seg)
        at = F.call_function("locate", s, raw, a["pos"])
        nums = numbers(F.substring(raw, a["pos"], at - a["pos"]))
        waiting = a["seen"] - a["used"]
        fits = (at > 0) & ((waiting == 0) | (F.size(nums) == waiting))
        moved = F.struct(
            fits.alias("ok"),
            F.when(at > 0, at + F.length(s)).otherwise(a["pos"]).alias("pos"),
            (a["seen"] + 1).alias("seen"),
            a["seen"].alias("used"),
            F.when(fits & (waiting > 0), F.concat(a["out"], pair(a, a["used"], a["seen"], nums))).otherwise(a["out"]).alias("out"),
        )
        passed = F.struct(a["ok"].alias("ok"), a["pos"].alias("pos"), (a["seen"] + 1).alias("seen"), a["used"].alias("used"), a["out"].alias("out"))
        return F.when(~a["ok"] | (F.length(s) == 0), passed).otherwise(moved)

    def finish(a):
        # seen is one too many: a marker follows each segment but the last
        waiting = a["seen"] - 1 - a["used"]
        nums = numbers(F.substring(raw, a["pos"], F.length(raw)))
        rest = F.when(F.size(nums) == waiting, F.concat(a["out"], pair(a, a["used"], a["seen"] - 1, nums)))
        return F.when(a["ok"], F.when(waiting <= 0, a["out"]).otherwise(rest))

    return F.aggregate(parts, start, step, finish)


def tier(between: Column) -> Column:
    """group, sentence or beyond, from the text between two markers."""
    filler = F.regexp_replace(between, f"(?i){MARKERS}|\\band\\b|\\bor\\b|&|[\\s,;:\\[\\]()\\-–—~]", "") == ""
    shielded = F.regexp_replace(between, f"(?i)\\b({ABBREVIATIONS})\\.", "$1․")
    ends = shielded.rlike("[.!?][\"')\\]]*\\s+[A-Z\\[(]") | F.regexp_replace(shielded, MARKERS, "").rlike("[.!?][\"')\\]]*\\s*$")
    return F.when(filler, "group").when(ends, "beyond").otherwise("sentence")


def stratum(clustering: Column, marker: Column, direct: Column, aligned: Column, overlap: Column, theta: float = 0.5, near: float = 0.2) -> Column:
    return (
        F.when(clustering & ~direct, "transitive")
        .when(clustering & marker, "both_routes")
        .when(marker, "marker_only")
        .when(clustering & aligned, "clustering_only_aligned")
        .when(clustering, "clustering_only_unaligned")
        .when(overlap >= min(near, theta), "near_miss")
        .when(overlap > 0, "weak_overlap")
        .otherwise("disjoint")
    )


def render(masked: Column, labels: Column) -> Column:
    """The text with its markers, in order, replaced by labels; markers beyond the labels become [cit]."""
    parts = F.split(masked, MARKERS, -1)
    label = lambda i: F.when(i < F.size(parts), F.coalesce(F.try_element_at(labels, i), F.lit("[cit]"))).otherwise(F.lit(""))
    return F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(""), lambda acc, i: F.concat(acc, F.try_element_at(parts, i), label(i)))
