"""Fill-in-the-middle: texts cut at two unit boundaries and put in the order that infilling models are trained on.

Everything is a column expression. A unit is a word with the white space before it, or the white
space at the end. ``MARK`` is written after each unit (``ESCAPE`` and ``MARK`` of the text itself
are escaped first, both by characters that are no white space, so units stay what they are);
marks are counted, two ranks are drawn from a hash of the id, and ``substring_index`` takes the
parts between them. The markers of the result have no common end and beginning and never stand in
a text that is cut, so the text can be told from the output and its form (``restored``).

Cases: a null text is empty, an empty text or one that holds a marker stays plain, whatever its
length; a null id is hashed as the empty string, so rows that repeat an id are cut at the same
draws; an empty table gives an empty one; other columns are carried only if named in ``keep``,
under their own names (a clash with a result's name is an error of Spark's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\x01", "\x02"
#: What stands for ESCAPE and MARK of a text.
OF_ESCAPE, OF_MARK = ESCAPE + "e", ESCAPE + "m"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def marked(text: Column) -> Column:
    """The escaped text with MARK after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OF_ESCAPE)), F.lit(MARK), F.lit(OF_MARK))
    return F.regexp_replace(escaped, UNIT, "$0" + MARK)


def plain(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(OF_MARK), F.lit(MARK)), F.lit(OF_ESCAPE), F.lit(ESCAPE))


def parts(text: Column, low: Column, high: Column, n: Column) -> tuple[Column, Column, Column]:
    """Of a marked text of n units: the first ``low``, those up to ``high``, and the rest."""
    index = lambda x, k: F.call_function("substring_index", x, F.lit(MARK), k.cast("int"))
    # the last of the n + 1 stretches between marks is the empty one after the last mark
    return plain(index(text, low)), plain(index(index(text, high), low - high)), plain(index(text, high - n - 1))


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of a seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transformed(docs: DataFrame, share: int = 50, suffix_first: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output) and ``keep``: about ``share`` percent of the texts are cut, of these ``suffix_first`` percent in the form spm, the others psm. The parts are null where the form is plain."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *(F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(keep)))
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    whole = (F.col("_text") == "") | (h3 >= 0) & (h3 % 100 >= share)
    for m in (PREFIX, SUFFIX, MIDDLE):
        whole |= F.contains("_text", F.lit(m))
    rows = rows.withColumn("_marked", marked(F.col("_text")))
    n = F.length("_marked") - F.length(F.replace(F.col("_marked"), F.lit(MARK), F.lit("")))
    rows = rows.withColumns({"_n": n.cast("bigint"), "_form": F.when(whole, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")})
    cuts = [h % (F.col("_n") + 1) for h in (h1, h2)]
    rows = rows.withColumns({"_low": F.least(*cuts), "_high": F.greatest(*cuts)})
    cut = F.col("_form") != "plain"
    names = ("_prefix", "_middle", "_suffix")
    rows = rows.withColumns({c: F.when(cut, x) for c, x in zip(names, parts(F.col("_marked"), F.col("_low"), F.col("_high"), F.col("_n")), strict=True)})
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(~cut, F.col("_text")).when(F.col("_form") == "spm", spm).otherwise(psm)
    return rows.select(F.col("_id").alias(id_col), *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)), F.col("_n").alias("n"), F.col("_form").alias("form"), *(F.col(c).alias(c[1:]) for c in names), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from."""
    first = lambda x, m: F.call_function("substring_index", x, F.lit(m), F.lit(1))
    rest = lambda x, m: F.call_function("substring_index", x, F.lit(m), F.lit(-1))
    head, middle = first(output, MIDDLE), rest(output, MIDDLE)
    spm = F.concat(rest(head, PREFIX), middle, rest(first(head, PREFIX), SUFFIX))
    psm = F.concat(rest(first(head, SUFFIX), PREFIX), middle, rest(head, SUFFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
