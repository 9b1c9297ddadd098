"""Fill-in-middle: a delimiter is escaped and put behind every unit, so that counting it numbers the units and substring_index cuts at their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, released, table

#: White space and the word behind it, or the white space that ends a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, and what it is escaped with. Neither is white space, so units stay as they are.
MARK, ESCAPE = "\x02", "\x01"


def escaped(text: Column) -> Column:
    """Without the delimiter: it and the escape become two characters each, of a word's kind like themselves."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """The text of a part: delimiters go, then the escapes."""
    whole = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(whole, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter behind each unit."""
    return F.regexp_replace(escaped(text), UNIT, f"$0{MARK}")


def ranked(units: Column, n: Column, first: Column, last: Column) -> list[Column]:
    """The text of a ``marked`` column in three: the first ``first`` of its ``n`` units, those up to ``last``, and the rest."""
    upto = F.call_function("substring_index", units, F.lit(MARK), last)
    head = F.call_function("substring_index", upto, F.lit(MARK), first)
    # Counted from the right: what is behind the last but so many delimiters.
    middle = F.call_function("substring_index", upto, F.lit(MARK), first - last)
    tail = F.call_function("substring_index", units, F.lit(MARK), last - n - 1)
    return [unescaped(x) for x in (head, middle, tail)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers cannot arise where text and markers meet, so each stands there once."""

    def between(a: str | None, b: str | None) -> Column:
        cut = F.substring_index(output, a, -1) if a else output
        return F.substring_index(cut, b, 1) if b else cut

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with ``output``, ``form`` (plain, psm or spm), ``n`` (units of the text), ``prefix_chars`` and ``middle_chars``.

    Of 100 documents ``rate`` are cut in three between units and put together as prefix, suffix, middle (psm), or suffix, prefix, middle (spm, of 100 of these ``suffix_first``), each part behind its marker; the others, and texts that are empty or hold a marker, stay as they are (plain, without lengths). The cuts and the form follow from the SHA-256 of ``seed:doc_id`` alone, so reruns agree and rows that share a doc_id are treated alike; a null doc_id counts as an empty one. Null text counts as empty. Texts may be of any length, and hold the delimiter. Units are cut within no code point. An empty table gives no rows. Columns of ``docs`` with the names added are replaced; other names are free. All of it is a projection: no shuffle, no Python.
    """
    rows = carried(docs, ("output", "form", "n", "prefix_chars", "middle_chars"))
    text = F.coalesce("in_text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("in_doc_id").cast("string"), F.lit(""))), 256)
    # Steps are separate selects, so that what later ones use more than once is worked out once.
    drawn = rows.withColumn("digest", digest).withColumn("units", marked(text))
    drawn = drawn.withColumn("n", (F.length("units") - F.length(F.replace("units", F.lit(MARK), F.lit("")))).cast("long"))
    draw = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (draw[2] % 100 >= rate)
    cuts = [draw[k] % (F.col("n") + 1) for k in range(2)]
    cut = drawn.withColumns({"form": F.when(plain, "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm"), "first": F.least(*cuts).cast("int"), "last": F.greatest(*cuts).cast("int")})
    cutting = F.col("form") != "plain"
    parts = ranked(F.col("units"), F.col("n").cast("int"), F.col("first"), F.col("last"))
    made = cut.withColumn("parts", F.when(cutting, F.array(*parts)))
    head, middle, tail = (F.col("parts")[k] for k in range(3))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return released(made, output=output, form=F.col("form"), n=F.col("n"), prefix_chars=F.char_length(head).cast("long"), middle_chars=F.char_length(middle).cast("long"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; cases as in ``fill_middle``."""
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))


#: The same rows by SQL, from a list of units.
ORACLE = r"""
WITH unit AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substring(digest, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substring(digest, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substring(digest, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substring(digest, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM unit
), part AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle, array_to_string(u[greatest(c1, c2) + 1 :], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM part
"""
