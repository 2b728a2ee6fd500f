"""Text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a heading, a reference or a citation.
ATX_HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)\s+(\S[^\n]{3,})$"
BRACKET_REFERENCE = r"\[[\d,\s–\-]+\]"
AUTHOR_YEAR = r"\(\w[^)]{2,40}\d{4}\w?\)"
DOI = r"(?i)doi:\s*10\.\d{4,}/\S+"
URL = r"https?://\S+"
CITED_NUMBERS = r"\[(\d+(?:[,;]\s*\d+)*)\]"
CITED_DOI = r"(?i)doi:\s*(10\.\d{4,}/\S+)"
CITED_URL = r"https?://[^\s>\"']+"
LIST_MARK = r"^\s*(?:\d+[.)]|[-*•])\s*"
SPACED_OUT = r"(?<!\S)[\w.]( [\w.]){2,}(?!\S)"
TOKEN = "[a-z0-9]+"


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_len(text: Column) -> Column:
    """Default token counter: words and single other signs. A model's own tokeniser can be plugged into the chunker."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def text_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def chunk_id(source: Column, doc_id: Column, position: Column, text: Column, prefix: int = 64) -> Column:
    """First 16 hex digits of SHA-256 over source:doc:position:beginning of the text."""
    return text_hash(F.concat_ws(":", source, doc_id.cast("string"), position.cast("string"), F.substring(text, 1, prefix)))


def heading_level(line: Column) -> Column:
    """Number of # signs, or dots of a leading number plus one; null for other lines."""
    line = F.trim(line)
    marks = F.regexp_extract(line, ATX_HEADING, 1)
    number = F.regexp_extract(line, NUMBERED_HEADING, 1)
    return F.when(marks != "", F.length(marks)).when(number != "", F.size(F.split(number, r"\.")))


def heading_title(line: Column) -> Column:
    line = F.trim(line)
    atx = F.regexp_extract(line, ATX_HEADING, 2)
    return F.when(atx != "", F.trim(atx)).when(F.regexp_extract(line, NUMBERED_HEADING, 1) != "", line)


def heading_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: heading_level(x).isNotNull()))


def select_strategy(text: Column, has_embedder: bool) -> Column:
    """Structural with two headings or more, else semantic where there is an embedder."""
    return F.when(heading_count(text) >= 2, "structural").otherwise("semantic" if has_embedder else "structural")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _strip_end(x: Column) -> Column:
    return F.regexp_replace(x, r"[.,;)]+$", "")


def extract_references(text: Column) -> Column:
    """Bracketed numbers, author-year mentions, DOIs and URLs, each once, in that order."""
    return F.array_distinct(F.concat(_all(text, BRACKET_REFERENCE), _all(text, AUTHOR_YEAR), _all(text, DOI), F.transform(_all(text, URL), _strip_end)))


def citation_keys(text: Column) -> Column:
    """Keys that texts share by citing the same thing: ref:n, doi:..., url:..."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITED_NUMBERS), F.lit(1))
    refs = F.transform(F.flatten(F.transform(groups, lambda x: F.split(x, r"[,;]\s*"))), lambda x: F.concat(F.lit("ref:"), F.trim(x)))
    dois = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITED_DOI), F.lit(1)), lambda x: F.concat(F.lit("doi:"), F.lower(x)))
    urls = F.transform(_all(text, CITED_URL), lambda x: F.concat(F.lit("url:"), _strip_end(x)))
    return F.array_distinct(F.concat(refs, dois, urls))


def parse_questions(raw: Column, n: int) -> Column:
    """Lines without numbering or bullets, blank ones dropped, the first n."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), LIST_MARK, "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def parse_concepts(raw: Column) -> Column:
    """Concepts of a JSON answer: lower case, trimmed, each once, sorted; none for anything unreadable."""
    got = F.from_json(raw, "concepts array<string>").getField("concepts")
    clean = F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def parse_entities(raw: Column) -> Column:
    """Lines TEXT|TYPE as structs of text, label and normalised text."""
    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.instr(x, "|") > 0)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.split(x, r"\|", 2)[0]).alias("text"), F.trim(F.split(x, r"\|", 2)[1]).alias("label"), F.lower(F.trim(F.split(x, r"\|", 2)[0])).alias("normalized")
        ),
    )


def table_to_md(rows: Column) -> Column:
    """Rows of cells (array of arrays) as lines with ' | ' between cells; blank rows go."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"[\s|]", "") != ""), "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def snippet(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def label_of(text: Column, n: int) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def section_label(section_path: Column, doc: Column, index: Column) -> Column:
    """Last heading, else the document, else a numbered chunk."""
    return F.coalesce(F.when(F.size(section_path) > 0, F.element_at(section_path, -1)), doc, F.concat(F.lit("chunk "), index.cast("string")))


#: ISO 639-1 codes and names.
LANGUAGES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish",
    "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "tr": "Turkish",
}


def language_name(code: Column) -> Column:
    """A language's name; the code itself where it isn't known."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(code)), code)


#: Frequent words that tell the languages apart, for the default detector.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "for", "with", "was", "this"),
    "fr": ("le", "la", "les", "des", "est", "que", "pour", "dans", "une", "du"),
    "de": ("der", "die", "das", "und", "mit", "ist", "nicht", "ein", "von", "zu"),
    "es": ("el", "los", "las", "que", "del", "una", "por", "con", "para", "se"),
}


def detect_language(text: Column, fallback: str = "en") -> Column:
    """The language with most stop words; the fallback for texts under 20 signs or without any. An approximation of a trained detector."""
    toks = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")

    def hits(known: tuple[str, ...]) -> Column:
        return F.size(F.filter(toks, lambda t: t.isin(*known)))

    scores = {code: hits(known) for code, known in STOP_WORDS.items()}
    best = F.greatest(*scores.values())
    out = F.lit(fallback)
    for code in reversed(list(scores)):
        out = F.when((scores[code] == best) & (best > 0), F.lit(code)).otherwise(out)
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 20, F.lit(fallback)).otherwise(out)
