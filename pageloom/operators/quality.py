"""Page quality: every detector from one projection over the page, and reports by book."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pystr import SPACE_SET, SPACES, WORD, given, strip
from ..functions.scalar import one_decimal

# Characters that text seldom has; patterns of misread characters; brackets and quotes that should balance.
GARBAGE = "□■◊◆●○►▼▲★☆♦♣♠♥※†‡¶§¤¢£¥€"
CONFUSIONS = (
    ("[0O]{3}", "Possible 0/O confusion"),
    ("[1Il]{3}", "Possible 1/I/l confusion"),
    (f"rn(?={WORD})", "Possible 'rn' vs 'm' confusion"),
    (f"(?<!{WORD})vv(?={WORD})", "Possible 'vv' vs 'w' confusion"),
)
#: What stands in each match of these patterns, if anything does.
HINTS = (None, None, "rn", "vv")
BRACKETS, QUOTES = ("()", "[]", "{}"), ("\"", "'")
REPEATED = r"([^\n])\1{4,}"
#: What each detector finds and the figures that it judges by, in the detectors' order.
DETECTORS = (
    ("SHORT_PAGE", "full short head"),
    ("GARBAGE_CHARS", "full size text garbage"),
    ("REPEATED_CHARS", "text runs"),
    *(("OCR_CONFUSION", f"confusion{k}") for k in range(len(CONFUSIONS))),
    ("SHORT_WORDS", "words solid"),
    *(("UNBALANCED_BRACKETS", f"open{k} close{k}") for k in range(len(BRACKETS))),
    *(("UNBALANCED_QUOTES", f"quotes{k}") for k in range(len(QUOTES))),
    ("HIGH_SPECIAL_CHAR_RATIO", "full size special"),
)
FINDING = "struct<seq:int,severity:string,error_type:string,n:bigint,message:string,context:string>"


def occurrences(text: Column, char: str) -> Column:
    return F.when(F.contains(text, F.lit(char)), F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).otherwise(0)  # to look is cheaper than to replace


def percent_text(ratio: Column) -> Column:
    return F.concat(one_decimal(ratio * 100), F.lit("%"))


def measured(text: Column, kinds: Collection[str] | None = None) -> Column:
    """All figures that the detectors (of these kinds) judge by, as one struct."""
    used = {x for kind, names in DETECTORS if kinds is None or kind in kinds for x in names.split()}
    spaced = F.translate(text, SPACES, " " * len(SPACES))  # one kind of space, so that words are counted without listing them
    both = given(spaced, lambda s: F.struct(s.alias("spaced"), F.length(F.replace(s, F.lit(" "), F.lit(""))).alias("solid")))
    return given(both, lambda b: figures(text, b["spaced"], b["solid"], used))


def figures(text: Column, spaced: Column, solid: Column, used: Collection[str]) -> Column:
    """The figures of these names of a text; ``spaced``: the text with each white space as a blank, ``solid``: its length without these."""
    size, blank = F.length(text), F.lit(" ")
    # where blanks follow one another, a run of them becomes one pair of characters that are white space, of which none is left
    paired = F.length(F.replace(F.replace(spaced, blank, F.lit("\x1c\x1d")), F.lit("\x1d\x1c"), F.lit("")))
    gaps = F.when(F.contains(spaced, F.lit("  ")), ((paired - solid) / 2).cast("int")).otherwise(size - solid)
    ends = F.startswith(spaced, blank).cast("int") + F.endswith(spaced, blank).cast("int")
    any_garbage = reduce(lambda a, c: a | F.contains(text, F.lit(c)), GARBAGE[1:], F.contains(text, F.lit(GARBAGE[0])))
    found = {
        "full": text != "",
        "size": size,
        "short": F.length(strip(text)),
        "head": F.left(text, F.lit(50)),
        "text": text,
        "garbage": F.when((F.octet_length(text) > size) & any_garbage, size - F.length(F.translate(text, GARBAGE, ""))).otherwise(0),
        "runs": F.regexp_count(text, F.lit(REPEATED)),
        "words": F.when(solid > 0, gaps + 1 - ends).otherwise(0),
        "solid": solid,
        "special": F.regexp_count(spaced, F.lit(r"[^\p{L}\p{N} ]")),
    }
    for k, ((pattern, _), hint) in enumerate(zip(CONFUSIONS, HINTS, strict=True)):
        n = F.regexp_count(text, F.lit(pattern))
        found[f"confusion{k}"] = n if hint is None else F.when(F.contains(text, F.lit(hint)), n).otherwise(0)
    found |= {f"open{k}": occurrences(text, a) for k, (a, _) in enumerate(BRACKETS)}
    found |= {f"close{k}": occurrences(text, b) for k, (_, b) in enumerate(BRACKETS)}
    found |= {f"quotes{k}": occurrences(text, q) for k, q in enumerate(QUOTES)}
    return F.struct(*[x.alias(name) for name, x in found.items() if name in used])


def page_findings(text: Column, min_length: int = 50, max_ratio: float = 0.15, min_word: float = 2.0, kinds: Collection[str] | None = None) -> Column:
    """The findings on one page's text, in the detectors' order; each figure is computed once. ``kinds``: only these are looked for."""
    return given(measured(text, kinds), lambda m: judged(m, min_length, max_ratio, min_word, kinds))


def judged(m: Column, min_length: int, max_ratio: float, min_word: float, kinds: Collection[str] | None = None) -> Column:
    """The findings (of these kinds) that a page's figures give."""

    def finding(seq: int, severity: Column | str, kind: str, n: Column, message: Column, context: Column | None = None) -> Column:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(seq).alias("seq"), severity.alias("severity"), F.lit(kind).alias("error_type"), n.cast("bigint").alias("n"), message.alias("message"), (F.lit("") if context is None else context).alias("context"))

    size, full, short = m["size"], m["full"], m["short"]
    found = [F.when(~full | (short < min_length), finding(0, F.when(full, "warning").otherwise("error"), "SHORT_PAGE", short, F.format_string("Page has only %d characters", short), m["head"]))]
    garbage = m["garbage"]
    seen = F.array_join(F.filter(F.array(*map(F.lit, sorted(GARBAGE))), lambda c: F.contains(m["text"], c)), "")
    found.append(F.when(full & (garbage / size > 0.01), finding(1, "warning", "GARBAGE_CHARS", garbage, F.concat(F.format_string("Found %d suspicious characters (", garbage), percent_text(garbage / size), F.lit(")")), seen)))
    firsts = F.slice(F.regexp_extract_all(m["text"], F.lit(REPEATED), F.lit(1)), 1, 5)
    shown_runs = F.concat(F.lit("["), F.array_join(F.transform(firsts, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    found.append(F.when(m["runs"] > 0, finding(2, "warning", "REPEATED_CHARS", m["runs"], F.format_string("Found %d instances of repeated characters", m["runs"]), shown_runs)))
    for k, (_, said) in enumerate(CONFUSIONS):
        n = m[f"confusion{k}"]
        found.append(F.when(n > 3, finding(3 + k, "info", "OCR_CONFUSION", n, F.format_string(f"{said}: found %d instances", n))))
    mean = m["solid"] / m["words"]
    found.append(F.when((m["words"] > 0) & (mean < min_word), finding(7, "warning", "SHORT_WORDS", m["words"], F.concat(F.lit("Average word length is "), one_decimal(mean), F.lit(f" (expected >{min_word})")))))
    for k, (opening, closing) in enumerate(BRACKETS):
        a, b = m[f"open{k}"], m[f"close{k}"]
        found.append(F.when(F.abs(a - b) > 2, finding(8 + k, "info", "UNBALANCED_BRACKETS", F.abs(a - b), F.format_string(f"Unbalanced {opening}{closing}: %d open, %d close", a, b))))
    for k, quote in enumerate(QUOTES):
        n = m[f"quotes{k}"]
        shown = "'\"'" if quote == '"' else '"\'"'
        found.append(F.when((n % 2 != 0) & (n > 2), finding(11 + k, "info", "UNBALANCED_QUOTES", n, F.concat(F.lit(f"Odd number of {shown} characters: "), n.cast("string")))))
    special = m["special"]
    found.append(F.when(full & (special / size > max_ratio), finding(13, "warning", "HIGH_SPECIAL_CHAR_RATIO", special, F.concat(F.lit("Special character ratio is "), percent_text(special / size), F.lit(f" (threshold: {max_ratio:.1%})")))))
    found = [x for x, (kind, _) in zip(found, DETECTORS, strict=True) if kinds is None or kind in kinds]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def with_findings(pages: DataFrame, text: str = "text", success: str | None = None, min_length: int = 50, max_ratio: float = 0.15, min_word: float = 2.0, kinds: Collection[str] | None = None) -> DataFrame:
    """(book_id, page_no, findings): the findings of each page as an array. ``success``: a flag column; false puts OCR_FAILED first. A null text is empty. ``kinds``: of the findings on the text only these are looked for."""
    every = page_findings(F.coalesce(F.col(text), F.lit("")), min_length, max_ratio, min_word, kinds).cast(f"array<{FINDING}>")
    if success is not None:
        failed = F.array(F.struct(F.lit(-1).alias("seq"), F.lit("error").alias("severity"), F.lit("OCR_FAILED").alias("error_type"), F.lit(0).cast("bigint").alias("n"), F.lit("OCR processing failed for this page").alias("message"), F.lit("").alias("context"))).cast(f"array<{FINDING}>")
        every = F.concat(F.when(~F.coalesce(F.col(success), F.lit(True)), failed).otherwise(F.array().cast(f"array<{FINDING}>")), every)
    return pages.select("book_id", "page_no", every.alias("findings"))


def findings(pages: DataFrame, text: str = "text", success: str | None = None, **limits) -> DataFrame:
    """(book_id, page_no, seq, severity, error_type, n, message, context): one scan, a row per finding."""
    rows = with_findings(pages, text, success, **limits)
    # an inner explode would have Spark filter by the findings' number first, and so find them twice
    return rows.select("book_id", "page_no", F.explode_outer("findings").alias("f")).where("f is not null").select("book_id", "page_no", "f.*")


def totals() -> list[Column]:
    """Over with_findings: total_pages, successful_pages, n_errors, n_warnings, n_infos."""
    failed = F.count_if(F.exists("findings", lambda f: f["error_type"] == "OCR_FAILED"))
    severities = F.transform("findings", lambda f: f["severity"])
    n = [F.sum(F.size("findings") - F.size(F.array_remove(severities, s))).alias(f"n_{s}s") for s in ("error", "warning", "info")]
    return [F.count("*").alias("total_pages"), (F.count("*") - failed).alias("successful_pages"), *n]


def report(pages: DataFrame, text: str = "text", success: str | None = None, **limits) -> DataFrame:
    """(book_id, total_pages, successful_pages, n_errors, n_warnings, n_infos, has_critical_errors) of each book, from one scan."""
    out = with_findings(pages, text, success, **limits).groupBy("book_id").agg(*totals())
    return out.withColumn("has_critical_errors", F.col("n_errors") > 0)


def report_line(page_no: Column, f: Column) -> Column:
    """The report's line for a finding."""
    marker = F.when(f["severity"] == "error", "[ERROR]").when(f["severity"] == "warning", "[WARN] ").otherwise("[INFO] ")
    context = F.when(F.length(f["context"]) > 100, F.concat(F.left(f["context"], F.lit(100)), F.lit("..."))).otherwise(f["context"])
    detail = F.when(context != "", F.concat(F.lit("\n           Context: '"), F.replace(context, F.lit("\n"), F.lit("\\n")), F.lit("'"))).otherwise("")
    return F.concat(F.format_string("Page %4d ", page_no), marker, F.lit(" "), f["error_type"], F.lit("\n           "), f["message"], detail)


def report_lines(found: DataFrame) -> DataFrame:
    """(book_id, page_no, severity, seq, line): the report's line for each finding; in the order of these columns."""
    finding = F.struct("severity", "error_type", "message", "context")
    return found.select("book_id", "page_no", "severity", "seq", report_line(F.col("page_no"), finding).alias("line"))


def report_text(pages: DataFrame, text: str = "text", success: str | None = None, **limits) -> DataFrame:
    """(book_id, report): the whole error report of each book, from one scan. A page's findings become its lines before they are shuffled."""
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["seq"].alias("seq"), report_line(F.col("page_no"), f).alias("line"))))
    page = F.when(F.size("findings") > 0, F.struct("page_no", F.array_join(F.transform(ranked, lambda x: x["line"]), "\n\n").alias("lines")))
    rows = with_findings(pages, text, success, **limits).withColumn("_page", page)
    made = rows.groupBy("book_id").agg(*totals(), F.array_join(F.transform(F.array_sort(F.collect_list("_page")), lambda x: x["lines"]), "\n\n").alias("_issues"))
    top = F.concat(F.lit("OCR Error Report\n================\nTotal pages: "), F.col("total_pages"), F.lit("\nSuccessful: "), F.col("successful_pages"), F.lit("\nErrors: "), F.col("n_errors"), F.lit("\nWarnings: "), F.col("n_warnings"), F.lit("\n"))
    body = F.when(F.col("_issues") != "", F.concat(F.lit("\nIssues by page:\n" + "-" * 40 + "\n"), F.col("_issues"), F.lit("\n"))).otherwise("")
    return made.select("book_id", F.concat(top, body).alias("report"))
