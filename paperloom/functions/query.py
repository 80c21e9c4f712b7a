"""Column functions on queries: validation, classification, entities, rewrites, search parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SEARCH, SearchParams
from . import vrn
from .text import bind, bordered, stripped, words

#: Words without search value, in two variants.
STOP_WORDS = tuple(
    "a an the in on at to for of with by from about into through during before after above below between under over and or but if while "
    "because as so than i you he she it we they me him her us them my your his its our their is are was were be been being have has had do "
    "does did will would should could may might must can this that these those what which who when where why how all each every some any "
    "both few more most other such no not only own same too very just".split()
)
SEARCH_STOP_WORDS = tuple(
    "the a an and or but in on at to for of with is are was were be been have has do does did will would could should may might can this "
    "that these those it its what which who whom where when why how".split()
)
SINGLE_STOP_WORDS = tuple("the a an in on at to for of and or is are was were be have has had do does".split())
#: Acronyms of vehicle papers.
ACRONYMS = {
    "vrn": "vehicle registration number",
    "nct": "national car test",
    "cvrt": "commercial vehicle roadworthiness test",
    "ncr": "national car registry",
    "vin": "vehicle identification number",
}
#: Patterns of attacks.
SQL_ATTACKS = (r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b", r"(--|;|/\*|\*/)", r"(\bOR\b.*=.*|AND\b.*=.*)", r"(UNION\s+SELECT)")
SCRIPT_ATTACKS = (r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe")
#: Phrases that ask for documents, for counts, and about the system.
DOCUMENT_PHRASES = ("tell me about", "show me", "all information", "complete information", "full document", "all details", "everything about", "all chunks", "entire document")
COUNT_PHRASES = ("how many", "count", "total number", "number of", "all cars", "all vehicles", "all our", "list all", "show all", "tell me about our", "tell me about all")
COUNT_FORMS = (r"all\s+\w+", r"how\s+many", r"list\s+all", r"show\s+(me\s+)?all", r"count\s+", r"total\s+")
#: What a counting query is searched as.
COUNT_REWRITES = (
    (r"all\s+vehicles?", "vehicle registration number VRN insurance"),
    (r"how\s+many\s+(cars?|vehicles?)", "vehicle registration number insurance NCT VRN"),
    (r"list\s+all\s+(cars?|vehicles?|vrns?)", "vehicle registration number VRN insurance NCT"),
    (r"show\s+(me\s+)?all\s+(cars?|vehicles?)", "vehicle registration documents insurance NCT"),
    (r"count\s+(cars?|vehicles?)", "vehicle registration number VRN insurance NCT"),
)
COUNT_REWRITE = "vehicle registration number documents insurance NCT VRN"
#: Words that tell what a query is about.
VEHICLE_WORDS = "vehicle car van truck ford toyota honda transit corolla civic registration vrn vin make model year colour color".split()
PERSON_WORDS = "driver owner person name john mary michael".split()
DOCUMENT_WORDS = "insurance nct certificate document record cert policy test inspection tax disc service maintenance repair fuel toll receipt".split()
DATE_WORDS = "expiry expire date when renewal valid until".split()
PERSON_PHRASES = ("who is", "tell me about", "show me", "find", "about")
QUESTION_WORDS = ("Tell", "Show", "Find", "What", "Who", "Where", "When", "Why", "How")
#: Entity forms with their confidence.
ENTITY_FORMS = ((r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0, 0.8), (r"\b[A-Z][a-z]+\b", 0, 0.6), (r"(?:about|is|find|show)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1, 0.7))
#: Rewrites of question forms, and templates for what is missing.
QUESTION_REWRITES = (
    (r"tell me about (.+)", ("%s", "information about %s", "details about %s")),
    (r"who is (.+)", ("%s", "%s biography", "%s information")),
    (r"show me (.+)", ("%s", "find %s", "%s documents")),
    (r"find (?:information )?(?:about )?(.+)", ("%s", "%s info", "%s details")),
    (r"what (?:about|is) (.+)", ("%s", "%s information", "about %s")),
    (r"give me (.+)", ("%s", "provide %s", "%s information")),
)
TEMPLATES = ("%s information", "%s details", "%s documents", "%s training", "%s certifications", "about %s", "find %s", "%s profile")
CORE_STOP_WORDS = "tell me about who is show find what give the a an".split()


def any_phrase(text: Column, phrases) -> Column:
    return vrn.any_of([F.lower(text).contains(p) for p in phrases])


def any_form(text: Column, forms, flags: str = "(?i)") -> Column:
    return vrn.any_of([F.regexp_like(text, F.lit(flags + bordered(f))) for f in forms])


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def validate(query: Column, max_length: int = 1000, special_share: float = 0.3) -> Column:
    """Struct (is_valid, sanitized, error)."""
    trimmed = F.regexp_replace(query, r"^\s+|\s+$", "")
    special = F.length(F.regexp_replace(trimmed, r"[\p{L}\p{N}\s\-_.,?!'\"]", ""))
    error = (
        F.when(query.isNull() | (query == ""), "empty")
        .when(F.length(query) > max_length, "too_long")
        .when(trimmed == "", "empty")
        .when(any_form(trimmed, SQL_ATTACKS), "sql_pattern")
        .when(any_form(trimmed, SCRIPT_ATTACKS), "script_pattern")
        .when(special > F.length(trimmed) * special_share, "special_characters")
    )
    return F.struct(error.isNull().alias("is_valid"), F.when(error.isNull(), squeeze(query)).otherwise("").alias("sanitized"), error.alias("error"))


def clamp_top_k(k: Column, low: int = 1, high: int = 50) -> Column:
    return F.struct(F.greatest(F.lit(low), F.least(F.lit(high), k)).alias("value"), k.between(low, high).alias("was_valid"))


def clamp_threshold(t: Column) -> Column:
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("value"), t.between(0.0, 1.0).alias("was_valid"))


def precheck(query: Column) -> Column:
    """Reason to reject a query, or null."""
    return F.when(query.isNull() | (F.trim(query) == ""), "empty").when(F.length(F.trim(query)) < 2, "too_short").when(F.regexp_like(query, F.lit("^[^a-zA-Z0-9]+$")), "only_special")


def without_stop_words(query: Column, stop=STOP_WORDS) -> Column:
    """Struct (kept, removed): words compared in lower case without punctuation."""
    is_stop = lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z0-9_]", "")).isin(*stop)
    return F.struct(F.array_join(F.filter(words(query), lambda w: ~is_stop(w)), " ").alias("kept"), F.filter(words(query), is_stop).alias("removed"))


def needs_enhancement(query: Column) -> Column:
    """A single short word, a known acronym, or a letter three times over."""
    tokens = words(F.lower(query))
    return ((F.size(tokens) == 1) & (F.length(F.get(tokens, F.lit(0))) <= 4)) | F.exists(tokens, lambda t: t.isin(*ACRONYMS)) | F.exists(tokens, lambda t: (F.length(t) > 3) & F.regexp_like(t, F.lit(r"(.)\1{2,}")))


def expand_acronyms(query: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ACRONYMS.items() for x in kv))
    return F.array_join(F.transform(words(query), lambda w: F.coalesce(known[F.lower(w)], w)), " ")


def search_terms(query: Column) -> Column:
    """Lower-case words of over two characters that aren't stop words."""
    return F.filter(words(F.lower(query)), lambda w: (F.length(w) > 2) & ~w.isin(*SEARCH_STOP_WORDS))


def required_terms(entity: Column) -> Column:
    return F.filter(words(F.lower(entity)), lambda w: F.length(w) > 2)


def is_count_query(query: Column) -> Column:
    return any_form(F.trim(F.lower(query)), COUNT_FORMS, "^")


def rewrite_count_query(query: Column) -> Column:
    low, out = F.trim(F.lower(query)), None
    for form, text in COUNT_REWRITES:
        test = F.regexp_like(low, F.lit("^" + form))
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.when(is_count_query(query), COUNT_REWRITE).otherwise(query)


def document_kind(query: Column) -> Column:
    """VRN, Document, Aggregation, or null for a query that doesn't ask for whole documents."""
    return F.when(F.regexp_like(query, F.lit(r"(?i)\d{2,3}-[A-Z]-\d{4,5}")), "VRN").when(any_phrase(query, COUNT_PHRASES), "Aggregation").when(any_phrase(query, DOCUMENT_PHRASES), "Document")


def intent(query: Column) -> Column:
    """Struct (is_valid, intent, confidence) by rules."""
    q, tokens = F.trim(query), words(F.lower(query))
    has = lambda values: F.arrays_overlap(tokens, F.array(*map(F.lit, values)))
    rules = [
        (q == "", "invalid", 1.0),
        (F.length(q) < 2, "invalid", 1.0),
        ((F.size(tokens) == 1) & F.lower(q).isin(*SINGLE_STOP_WORDS), "invalid", 0.95),
        (F.regexp_like(q, F.lit(r"\d{2,3}-[A-Z]-\d{4,5}")), "vehicle_search", 0.95),
        (F.regexp_like(q, F.lit(bordered(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"))), "person_search", 0.85),
        (has(VEHICLE_WORDS), "vehicle_search", 0.75),
        (has(PERSON_WORDS), "person_search", 0.75),
        (has(DOCUMENT_WORDS), "document_search", 0.75),
        (has(DATE_WORDS), "date_search", 0.70),
        (F.size(tokens) >= 2, "unknown", 0.50),
    ]
    name = confidence = None
    for test, label, value in rules:
        name = F.when(test, label) if name is None else name.when(test, label)
        confidence = F.when(test, value) if confidence is None else confidence.when(test, value)
    name, confidence = name.otherwise("invalid"), confidence.otherwise(0.80)
    return F.struct((name != "invalid").alias("is_valid"), name.alias("intent"), confidence.alias("confidence"))


def entity(query: Column) -> Column:
    """Struct (entity, confidence, method, alternatives): the most confident name-like candidate; the whole query at 0.3 if there is none."""

    def candidates(q: Column, low: Column, form: str, group: int, base: float, rank: int) -> Column:
        def one(m: Column, i: Column) -> Column:
            place = F.instr(low, F.lower(m)) - 1
            c = F.lit(base) + F.when(F.size(F.split(m, r"\s+")) > 1, 0.1).otherwise(0.0) - F.when(F.length(m) > F.length(q) * 0.8, 0.2).otherwise(0.0)
            c = c + F.when(place >= 0, (F.lit(1.0) - place / F.length(q)) * 0.1).otherwise(0.0)
            return F.struct(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 9).alias("confidence"), (-F.lit(rank) * 10_000 - i).alias("order"), m.alias("entity"))

        found = F.filter(F.regexp_extract_all(q, F.lit(bordered(form)), F.lit(group)), lambda m: ~m.isin(*QUESTION_WORDS))
        return F.transform(found, one)

    def chosen(q: Column, every: Column, best: Column) -> Column:
        none = F.size(every) == 0
        others = F.transform(F.filter(every, lambda c: (c["entity"] != best["entity"]) & (c["confidence"] > 0.5)), lambda c: c["entity"])
        return F.struct(
            F.when(none, F.trim(q)).otherwise(best["entity"]).alias("entity"),
            F.when(none, 0.3).otherwise(best["confidence"]).alias("confidence"),
            F.when(none, "regex_fallback").otherwise("regex").alias("method"),
            others.alias("alternatives"),
        )

    every = lambda q, low: F.concat(*(candidates(q, low, f, g, b, i) for i, (f, g, b) in enumerate(ENTITY_FORMS)))
    # each step is bound: the candidates are found once, not once for each use and each candidate
    return bind(query, lambda q: bind(bind(F.lower(q), lambda low: every(q, low)), lambda e: bind(F.array_max(e), lambda best: chosen(q, e, best))))


def best_entity(results: Column, good: float = 0.7) -> Column:
    """Of an ordered array of entity structs the first above ``good``, else the most confident (the first of equals)."""
    top = F.array_max(F.transform(results, lambda r: r["confidence"]))
    return F.coalesce(F.get(F.filter(results, lambda r: r["confidence"] > good), F.lit(0)), F.get(F.filter(results, lambda r: r["confidence"] == top), F.lit(0)))


def validate_entity(name: Column, query: Column, known: tuple[str, ...] = ()) -> Column:
    questions = F.array(*map(F.lit, "question query extract name tell about who is find show".split()))
    score = (
        F.when(name.isNull() | (F.length(F.trim(name)) < 2), 0.0)
        .when(F.lower(name).isin(*known) if known else F.lit(False), 0.95)
        .when(F.arrays_overlap(words(F.lower(name)), questions), 0.1)
        .when(F.length(name) > F.length(query), 0.1)
        .otherwise(0.6)
    )
    return F.struct((score >= 0.6).alias("is_valid"), score.alias("confidence"))


def variants(found: Column, query: Column) -> Column:
    """The entity, two alternatives, and the query, without repeats."""
    return F.array_distinct(F.concat(F.array(found["entity"]), F.slice(found["alternatives"], 1, 2), F.array(F.trim(query))))


def rewrites(query: Column, n: int = 3) -> Column:
    """The query, then its rewrites: by the first question form that fits, then by templates until there are ``n``; no repeats in any case."""
    q, low = F.trim(query), F.lower(F.trim(query))
    by_form = None
    for form, templates in QUESTION_REWRITES:
        about = F.trim(F.regexp_extract(low, form, 1))
        made = F.array(*(F.concat(*_fill(t, about)) for t in templates))
        test = F.regexp_like(low, F.lit(form))
        by_form = F.when(test, made) if by_form is None else by_form.when(test, made)
    by_form = F.filter(by_form.otherwise(F.array().cast("array<string>")), lambda r: (r != "") & (r != low))
    core = F.array_join(F.filter(words(low), lambda w: ~w.isin(*CORE_STOP_WORDS)), " ")
    by_template = F.filter(F.array(*(F.concat(*_fill(t, core)) for t in TEMPLATES)), lambda r: (core != "") & (r != low))
    missing = F.greatest(F.lit(0), F.lit(n) - F.size(by_form))
    every = F.concat(by_form, F.slice(by_template, 1, missing))
    return F.concat(F.array(q), F.array_distinct(F.filter(every, lambda r: (r != low) & (F.length(r) > 2))))


def _fill(template: str, value: Column) -> list[Column]:
    before, after = template.split("%s")
    return [F.lit(before), value, F.lit(after)]


def rewrite_count(query: Column, params: SearchParams = SEARCH) -> Column:
    n = F.size(words(query))
    return F.when(n <= 2, max(1, params.max_rewrites - 1)).when(n >= 6, params.max_rewrites).otherwise(params.max_rewrites - 1)


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the smaller set; 0 where one has none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def listed_lines(text: Column) -> Column:
    """Lines of a model's list without numbers, bullets and quotes; headings and single words go."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda x: (x != "") & ~F.regexp_like(F.lower(x), F.lit("^(generate|search|queries|variations)")))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+[.)]\s*", ""), r"^[-•*]\s*", ""), "^[\"']+|[\"']+$", ""))
    return F.filter(bare, lambda x: F.size(words(x)) >= 2)


def search_params(query: Column, has_entity: Column, params: SearchParams = SEARCH) -> Column:
    """Struct (threshold, top_k, strategy, database_priority) by the shape of the query."""
    n = F.size(words(query))
    verb = any_phrase(query, ("tell", "show", "find", "give"))
    pick = lambda a, b, c, d: F.when(has_entity, a).when(n >= 4, b).when(verb, c).otherwise(d)
    return F.struct(
        pick(params.threshold, params.fallback_threshold, params.entity_threshold, params.threshold).alias("threshold"),
        pick(params.top_k, params.complex_top_k, params.entity_top_k, params.top_k).alias("top_k"),
        pick("hybrid", "vector_priority", "hybrid", "hybrid").alias("strategy"),
        pick(False, False, True, False).alias("database_priority"),
    )


def smart_threshold(query: Column, has_entity: Column, params: SearchParams = SEARCH) -> Column:
    return F.when(has_entity, params.threshold).when(F.size(words(query)) >= 6, params.fallback_threshold).otherwise(params.threshold)


def search_strategy(query: Column, has_entity: Column) -> Column:
    return F.when(has_entity | any_phrase(query, ("who is", "tell me about", "show me")), "database_priority").when(F.size(words(query)) >= 6, "vector_priority").otherwise("hybrid")


def is_person_query(query: Column, name: Column | None = None) -> Column:
    asked = any_phrase(query, PERSON_PHRASES) & F.regexp_like(query, F.lit(bordered(r"\b[A-Z][a-z]+\b")))
    return asked if name is None else F.coalesce(F.regexp_like(name, F.lit(bordered(r"(?i)\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"))), F.lit(False)) | asked


def complexity(query: Column) -> Column:
    n = F.size(words(query))
    return F.when(n <= 3, "simple").when(n <= 6, "medium").otherwise("complex")


def parsed_score(reply: Column) -> Column:
    """The number in a free-text reply, 5 if there is none, within 0 to 10."""
    value = F.try_to_number(F.nullif(F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("999999.999")).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(value, F.lit(5.0))))


def parsed_decisions(reply: Column, expected: Column) -> Column:
    """Per line whether it says RELEVANT; all are relevant where the number of lines differs from the expected."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.upper(F.trim(x))), lambda x: x.contains("RELEVANT"))
    return F.when(F.size(lines) == expected, F.transform(lines, lambda x: ~x.contains("NOT_RELEVANT"))).otherwise(F.array_repeat(F.lit(True), expected))


#: Intents that a reply may name.
INTENTS = ("vehicle_search", "person_search", "document_search", "date_query", "invalid", "unknown")


def parsed_validation(reply: Column) -> Column:
    """Struct (is_valid, intent, confidence, reason) from VALID / INTENT / CONFIDENCE / REASON lines, the last of each; an intent that isn't known is unknown."""
    lines = F.transform(F.split(reply, "\n"), stripped)

    def part(key: str) -> Column:
        return stripped(F.substring(F.try_element_at(F.filter(lines, lambda s: s.startswith(key)), F.lit(-1)), len(key) + 1, 2**31 - 1))

    intent = F.lower(part("INTENT:"))
    return F.struct(
        F.coalesce(F.lower(part("VALID:")).contains("yes"), F.lit(False)).alias("is_valid"),
        F.when(intent.isin(*INTENTS), intent).otherwise("unknown").alias("intent"),
        F.coalesce(part("CONFIDENCE:").try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(part("REASON:"), F.lit("LLM validation completed")).alias("reason"),
    )
