"""Column functions on text: cleaning, metrics, scores of converted documents, previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = " [TRUNCATED]"
#: A place between a letter, digit or underscore of any script and anything else: what ``\\b`` means to the forms here, whatever the Java version.
BORDER = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def bordered(form: str) -> str:
    """A form with its word borders spelled out; a border before a digit or a capital is only looked for there."""
    return form.replace(r"\b\d", r"(?=\d)\b\d").replace(r"\b[A-Z]", r"(?=[A-Z])\b[A-Z]").replace(r"\b", BORDER)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.transform(F.array(value), lambda x: use(x))[0]


#: File types of converted documents.
MIME_TO_EXTENSION = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/html": "html",
    "text/plain": "txt",
    "text/markdown": "md",
    "image/png": "png",
    "image/jpeg": "jpg",
}
EXTENSION_TO_TYPE = {"pdf": "pdf", "doc": "word", "docx": "word", "pptx": "presentation", "html": "web", "txt": "text", "md": "markdown", "png": "image", "jpg": "image"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def extension_of_mime(mime: Column, default: str = "bin") -> Column:
    return F.coalesce(_map(MIME_TO_EXTENSION)[F.lower(mime)], F.lit(default))


def type_of_extension(extension: Column, default: str = "unknown") -> Column:
    return F.coalesce(_map(EXTENSION_TO_TYPE)[F.lower(extension)], F.lit(default))


def clean(text: Column) -> Column:
    """Without control characters, but for tab, newline and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def clean_truncated(text: Column, limit: int = 50_000) -> Column:
    """Struct of cleaned text cut at ``limit`` with a marker, its original length, and whether anything changed."""
    cleaned = clean(text)
    cut = F.when(F.length(cleaned) > limit, F.concat(F.substring(cleaned, 1, limit), F.lit(TRUNCATED))).otherwise(cleaned)
    return F.struct(cut.alias("text"), F.length(text).alias("original_length"), (cut != text).alias("was_cleaned"))


def clean_map(values: Column, limit: int = 1000) -> Column:
    """A string map with each value cleaned and cut."""
    return F.transform_values(values, lambda _, v: F.substring(clean(v), 1, limit))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space words; none for an empty text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def metrics(text: Column) -> Column:
    """Struct of characters, words, lines and non-empty paragraphs."""
    return F.struct(
        F.length(text).alias("content_length"),
        F.size(words(text)).alias("word_count"),
        F.size(F.split(text, "\n")).alias("line_count"),
        F.size(F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != "")).alias("paragraph_count"),
    )


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


#: Words at a text's start that tell of a failed conversion.
FAILURE_WORDS = ("error", "could not", "unable to", "failed", "corrupted")


def quality_score(text: Column) -> Column:
    """0 to 100 for a converted document: short texts, few words and an early word of failure cost; headings, and lists of one kind of mark, give."""
    n, w = F.length(text), F.size(words(text))
    early = F.lower(F.substring(text, 1, 200))
    score = (
        F.lit(100)
        - F.when(n < 100, 30).when(n < 500, 15).otherwise(0)
        - F.when(w < 20, 20).when(w < 50, 10).otherwise(0)
        - F.when(F.exists(F.array(*map(F.lit, FAILURE_WORDS)), early.contains), 15).otherwise(0)
        + F.when(F.regexp_count(text, F.lit("#")) >= 2, 5).otherwise(0)
        + F.when((F.regexp_count(text, F.lit("\n-")) >= 3) | (F.regexp_count(text, F.lit(r"\n\*")) >= 3), 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("double")


def preview(text: Column, n: int = 200, more: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences, in any case; 0 for an empty phrase."""
    low, p = F.lower(text), F.lower(phrase)
    n = (F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)
    return F.when(F.length(p) > 0, n.cast("int")).otherwise(0)


def quoted(phrase: Column) -> Column:
    """A phrase as a regular expression for itself."""
    return F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def word_match(phrase: Column, text: Column) -> Column:
    """Whether the phrase occurs in the text at word borders, in any case; False for an empty phrase."""
    return F.when(F.trim(phrase) == "", F.lit(False)).otherwise(F.regexp_like(F.lower(text), F.concat(F.lit(BORDER), quoted(F.lower(phrase)), F.lit(BORDER))))


def output_path(path: Column, out_dir: str, stamp: Column | None = None) -> Column:
    """Markdown path that mirrors ``path`` below ``out_dir``, with an optional time stamp before the name."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = [F.lit(out_dir + "/"), F.regexp_replace(folder, "^/+", "")] + ([stamp, F.lit("_")] if stamp is not None else [])
    return F.concat(*parts, stem, F.lit(".md"))


IMAGE_MARK = "<!-- image -->"


def fill_images(text: Column, found: Column) -> Column:
    """Each image mark replaced, in order, by the text found for it; marks beyond the texts stay."""
    parts = F.split(text, IMAGE_MARK)
    more = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p, i: F.concat(F.coalesce(F.get(found, i), F.lit(IMAGE_MARK)), p))
    return F.concat(parts[0], F.array_join(more, ""))


def to_markdown(items: Column) -> Column:
    """Markdown of an array of (kind, level, text): headings by level, list items, anything else as a paragraph."""
    line = lambda x: F.when(x["kind"] == "heading", F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["text"])).when(
        x["kind"] == "list", F.concat(F.lit("- "), x["text"])
    ).otherwise(x["text"])
    return F.array_join(F.transform(items, line), "\n\n")


def is_iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text).isNotNull()


def is_coordinate_json(text: Column) -> Column:
    """Whether a conversion gave a code fence of coordinates in place of text."""
    return text.contains("```json") & (text.contains('"point') | text.contains('"bbox')) & text.contains('"text')


def conversion_verdict(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) < 10, "rejected").when(is_coordinate_json(text), "extract_again").otherwise("accepted")
