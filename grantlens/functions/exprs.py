"""Scalar functions as Columns: parsing, classification and normalisation, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of institutes and the two-letter codes of bulk files.
IC_CODES = {
    "NCI": "CA", "NIAID": "AI", "NIGMS": "GM", "NHLBI": "HL", "NIA": "AG", "NIDDK": "DK", "NINDS": "NS", "NIMH": "MH",
    "NICHD": "HD", "NIEHS": "ES", "NIDA": "DA", "NEI": "EY", "NIDCD": "DC", "NIDCR": "DE", "NIAMS": "AR", "NIBIB": "EB",
    "NHGRI": "HG", "NIAAA": "AA", "NCATS": "TR", "NIMHD": "MD", "NLM": "LM", "NINR": "NR", "NCCIH": "AT", "FIC": "TW",
}

# Prefix of an announcement number, its type, the folder of its page.
FOA_PREFIXES = [("RFA-", "RFA", "rfa"), ("PAR-", "PAR", "pa"), ("PAS-", "PAS", "pa"), ("PA-", "PA", "pa"), ("NOT-", "NOTICE", "notice")]
GUIDE_URL = "https://grants.nih.gov/grants/guide/%s-files/%s.html"

# Activity codes that their first letter does not classify.
CENTER_CODES = ["U19", "U54", "UM1", "UM2", "P2C", "UG3", "UH3"]
TRAINING_CODES = ["D43", "D71", "R25", "R90", "R38", "RL5", "TL1", "KL2"]

# Words that do not tell institutions apart.
INSTITUTION_WORDS = [
    "the", "inc", "incorporated", "llc", "ltd", "university", "univ", "college", "school", "of", "at", "medicine", "medical",
    "center", "centre", "hospital", "institute", "institutes", "and",
]

# Repositories and the pattern of their accession numbers.
ACCESSIONS = [
    ("dbGaP", r"\bphs\d{6}(?:\.v\d+\.p\d+)?\b"),
    ("GEO", r"\bG(?:SE|SM|PL|DS)\d{3,}\b"),
    ("SRA", r"\b(?:SR[APRSXZ]|ERR|ERX|ERP|ERS|DRR|DRX|DRP)\d{4,}\b"),
    ("BioProject", r"\bPRJ(?:NA|EB|DB)\d{3,}\b"),
    ("BioSample", r"\bSAM(?:N|EA|D)\d{4,}\b"),
    ("ImmPort", r"\bSDY\d{2,}\b"),
    ("ArrayExpress", r"\bE-[A-Z]{4}-\d+\b"),
    ("TCGA", r"\bTCGA-[0-9A-Z]{2}-[0-9A-Z]{4}\b"),
]
# Words near an accession number that make a deposit likelier, and how far they may be.
ACCESSION_CUES = [
    "accession", "deposit", "available", "archiv", "repositor", "database", "under", "geo", "dbgap", "sequence read archive",
    "data have been", "data are", "data is", "raw data",
]
ACCESSION_WINDOW = 60
GRANT_NUMBER = r"([A-Z][A-Z0-9][0-9])([A-Z]{2})([0-9]{6})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(_c(x), F.lit(""))


def contact(x: Column | str, flagged: str, part: int = 1) -> Column:
    """The entry flagged as contact in a ';' list, else the first; '' for a blank list, null for null."""
    x = _c(x)
    return F.coalesce(filled(F.trim(F.regexp_extract(x, flagged, part))), F.trim(F.split_part(x, F.lit(";"), F.lit(1))))


def contact_pi_id(x: Column | str) -> Column:
    return contact(x, r"([0-9]+) *\(contact\)")


def contact_pi_name(x: Column | str) -> Column:
    return contact(x, r"([^;]+)\(contact\)")


def ic_code(x: Column | str) -> Column:
    """Two-letter code of an institute's abbreviation; anything else upper-cased and trimmed."""
    key = F.trim(F.upper(_c(x)))
    codes = F.create_map(*[F.lit(v) for kv in IC_CODES.items() for v in kv])
    return F.coalesce(codes[key], key)


def _by_prefix(x: Column, otherwise: Column, part: int) -> Column:
    out = None
    for p in FOA_PREFIXES:
        out = (F if out is None else out).when(x.startswith(p[0]), F.lit(p[part]))
    return out.otherwise(otherwise)


def foa_type(x: Column | str) -> Column:
    """Type of an announcement number as bulk files have it: case counts, blanks are not trimmed."""
    x = _c(x)
    return F.when(x.isNull() | (x == ""), "NONE").otherwise(_by_prefix(x, F.lit("OTHER"), 1))


def foa_type_lenient(x: Column | str) -> Column:
    """As foa_type, of the trimmed upper-cased number; blanks alone are OTHER."""
    x = _c(x)
    return F.when(x.isNull() | (x == ""), "NONE").otherwise(_by_prefix(F.upper(F.trim(x)), F.lit("OTHER"), 1))


def guide_url(x: Column | str) -> Column:
    number = F.upper(F.trim(_c(x)))
    return F.format_string(GUIDE_URL, _by_prefix(number, F.lit("pa"), 2), number)


def mechanism_family(x: Column | str) -> Column:
    """research, center_core, training_career, intramural or other; the order of tests matters."""
    a = F.trim(F.upper(F.coalesce(_c(x), F.lit(""))))
    first = F.substring(a, 1, 1)
    return (
        F.when(a == "", "other")
        .when(a.startswith("DP"), "research")
        .when(first == "Z", "intramural")
        .when(a.isin(CENTER_CODES) | first.isin("P", "S", "G", "C"), "center_core")
        .when(a.isin(TRAINING_CODES) | first.isin("T", "F", "K"), "training_career")
        .when(first.isin("R", "U"), "research")
        .otherwise("other")
    )


def age_bucket(fiscal_year: Column | str, current_year: int) -> Column:
    fy = _c(fiscal_year)
    age = F.lit(current_year) - fy
    return F.when(fy.isNull() | (fy == 0), "UNKNOWN").when(age < 5, "0-4y").when(age < 10, "5-9y").otherwise("10y+")


def _plain(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[^\w\s]", " ")


def normalize_name(x: Column | str) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed; order and initials stay."""
    return F.trim(F.regexp_replace(_plain(x), r"(?U)\s+", " "))


def normalize_institution(x: Column | str) -> Column:
    stop = F.array(*map(F.lit, INSTITUTION_WORDS))
    words = F.split(_plain(x), r"(?U)\s+")
    return F.array_join(F.filter(words, lambda t: (t != "") & ~F.array_contains(stop, t)), " ")


def pi_key(orcid: Column | str, profile_id: Column | str, name: Column | str, institution: Column | str) -> tuple[Column, Column]:
    """Cluster key of an investigator and what it rests on; never merges unequal identifiers."""
    o, p, i = filled(orcid), _c(profile_id), filled(institution)
    norm = normalize_name(name)
    key = (
        F.when(o.isNotNull(), F.concat(F.lit("orcid:"), F.lower(F.trim(o))))
        .when(p.isNotNull(), F.concat(F.lit("profile:"), p.cast("string")))
        .when(i.isNotNull(), F.concat(F.lit("name:"), norm, F.lit("|inst:"), normalize_institution(i)))
        .otherwise(F.concat(F.lit("name:"), norm))
    )
    by = F.when(o.isNotNull(), "orcid").when(p.isNotNull(), "profile_id").when(i.isNotNull(), "name+institution").otherwise("name")
    return key, by


def institution_key(ror_id: Column | str, name: Column | str) -> tuple[Column, Column]:
    r = filled(ror_id)
    key = F.when(r.isNotNull(), F.concat(F.lit("ror:"), F.lower(F.trim(r)))).otherwise(F.concat(F.lit("name:"), normalize_institution(name)))
    return key, F.when(r.isNotNull(), "ror").otherwise("name")


def terms(x: Column | str) -> Column:
    """Terms of "<a><b>", or else of a list at ; and , ."""
    x = F.coalesce(_c(x), F.lit(""))
    tagged = F.regexp_extract_all(x, F.lit("<([^<>]+)>"), F.lit(1))
    listed = F.split(x, "[;,]")
    return F.filter(F.transform(F.when(F.size(tagged) > 0, tagged).otherwise(listed), lambda t: F.trim(t)), lambda t: t != "")


def grant_number(x: Column | str) -> Column:
    """The first core grant number in a text without spaces, upper-cased; '' if none."""
    return F.regexp_extract(F.upper(F.replace(_c(x), F.lit(" "), F.lit(""))), GRANT_NUMBER, 0)


def first_year(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"(\d{4})", 1).try_cast("int")


def yes_no(x: Column | str) -> Column:
    x = F.lower(F.trim(_c(x).cast("string")))
    return F.when(x.isin("yes", "true", "1"), True).when(x.isin("no", "false", "0"), False)


def lenient_int(x: Column | str) -> Column:
    """Text to a whole number by way of a double, cut off towards zero."""
    return F.replace(_c(x), F.lit(","), F.lit("")).try_cast("double").cast("long")


def rate(x: Column | str) -> Column:
    """A share; percentages become fractions."""
    value = F.regexp_replace(_c(x).cast("string"), "%", "").try_cast("double")
    return F.when(value > 1, value / 100).otherwise(value)


def contains_word(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def contains_any(text: Column | str, words: list[str]) -> Column:
    return contains_word(F.lower(F.coalesce(_c(text), F.lit(""))), words)


def split_node(x: Column | str) -> tuple[Column, Column]:
    """Type and id of a node name, at its first colon."""
    x = _c(x)
    return F.substring_index(x, ":", 1), F.regexp_replace(x, r"^[^:]*:?", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row: within the functions that array functions take, an expression is worked out for
    each element."""
    return F.get(F.transform(F.array(value), body), 0)


def accessions(text: Column | str) -> Column:
    """Accessions of a text: array of (accession, repository, surface_form, context, confidence, start), the best of each by start.

    One pattern of all repositories, whose numbers cannot overlap, splits the text; a match starts after the pieces and matches
    before it. Texts without a match, which are most, are only searched.
    """
    any_ = "|".join(f"(?:{pattern})" for _, pattern in ACCESSIONS)
    none = F.array().cast("array<struct<accession:string,repository:string,surface_form:string,context:string,confidence:double,start:int>>")

    def repository(surface: Column) -> Column:
        out = None
        for name, pattern in ACCESSIONS:
            out = (F if out is None else out).when(surface.rlike(f"^(?:{pattern})$"), F.lit(name))
        return out

    def found(x: Column) -> Column:
        hits, pieces = F.regexp_extract_all(x, F.lit(any_), F.lit(0)), F.split(x, any_, -1)
        steps = let(F.struct(hits.alias("h"), pieces.alias("p")), lambda v: F.transform(v["h"], lambda h, i: F.struct(F.length(F.get(v["p"], i)).alias("p"), h.alias("h"))))
        starts = let(steps, lambda v: F.transform(v, lambda z, i: F.struct(z["h"].alias("h"), (z["p"] + F.aggregate(F.slice(v, F.lit(1), i), F.lit(0), lambda n, y: n + y["p"] + F.length(y["h"]))).alias("start"))))
        ranked = F.array_sort(F.transform(starts, lambda z: described(x, z)), _by_accession)
        # the most confident of each accession, the first of equals: neighbours in this order
        new = lambda v, m, i: (i == 0) | (F.get(v, i - 1)["accession"] != m["accession"]) | (F.get(v, i - 1)["repository"] != m["repository"])
        best = let(ranked, lambda v: F.filter(v, lambda m, i: new(v, m, i)))
        plain = F.transform(best, lambda m: F.struct(*[m[c].alias(c) for c in ("accession", "repository", "surface_form", "context", "confidence", "start")]))
        return F.array_sort(plain, lambda a, b: _compare((a["start"], b["start"])))

    def described(x: Column, z: Column) -> Column:
        begin = F.greatest(z["start"] - ACCESSION_WINDOW, F.lit(0))
        around = F.substring(x, begin + 1, z["start"] + F.length(z["h"]) + ACCESSION_WINDOW - begin)
        facts = F.struct(repository(z["h"]).alias("repository"), around.alias("context"), z["h"].alias("h"), z["start"].alias("start"))
        return let(
            facts,
            lambda v: F.struct(
                v["repository"].alias("repository"),
                F.when(v["repository"] == "dbGaP", v["h"]).otherwise(F.upper(v["h"])).alias("accession"),
                F.when(F.lower(v["context"]).rlike("|".join(ACCESSION_CUES)), F.lit(0.97)).otherwise(F.lit(0.9)).alias("confidence"),
                v["start"].alias("start"),
                v["h"].alias("surface_form"),
                F.trim(v["context"]).alias("context"),
            ),
        )

    return let(F.coalesce(_c(text), F.lit("")), lambda x: F.when(x.rlike(any_), found(x)).otherwise(none))


def _compare(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def _by_accession(a: Column, b: Column) -> Column:
    return _compare((a["repository"], b["repository"]), (a["accession"], b["accession"]), (b["confidence"], a["confidence"]), (a["start"], b["start"]))


def parse_years(spec: str | None) -> list[int] | None:
    """'2020', '2018:2022' (either way round) and lists of both with commas."""
    if not spec:
        return None
    out: list[int] = []
    for part in spec.split(","):
        a, _, b = part.partition(":")
        low, high = sorted((int(a), int(b or a)))
        out += range(low, high + 1)
    return out
