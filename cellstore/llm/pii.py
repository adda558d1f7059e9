r"""Personal data: regular expressions propose spans, validators confirm them, context words adjust scores.

Only built-in functions run. Matches come from `regexp_extract_all`, the text between them from `split` with the same
expression; running sums of both lengths give code-point offsets. A text without the character that a kind needs isn't
searched for it. Running sums are folded in stretches of the square root of the matches' number, and context is taken from the text
between matches, so a text with n matches takes n steps and n^1.5 copied numbers.

The expressions are the base ones, written so that Java's engine needs linear time and no recursion on long texts:
possessive repetition, and a start only where a run of the first class begins (or where the last match ended, \G), since
a later start in the same run ends alike. Cards are runs of digits with single separators; runs of another length than
16 to 19 digits fail anyway, so the expression passes over them.

Kinds: email, ip (parts up to 255), card (Luhn), phone (8 to 15 digits), and beside those iban (mod-97), ssn (no unissued area, group or
serial) and secret (a name such as token or password with a value of 16 characters or more, with digits and 8 different characters; keys known by
their beginnings; private key blocks). A score is the kind's own certainty, plus a bonus if one of the kind's context words stands within `reach`
characters, as far as the text up to the next match of the kind on either side goes; 1 at most.

Defined cases: a null or empty text has no spans (counts 0, empty strings, digest of the empty string). Repeated rows
are judged each. A null id stays null. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import with_column_free

#: kind: (expression, what a text must have to be searched)
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", r"text rlike '[0-9]\\.[0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", r"text rlike '[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "text rlike '[A-Z][A-Z][0-9][0-9]'"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"text rlike '[0-9]-[0-9][0-9]-[0-9]'"),
    "secret": (
        r"(?<![A-Za-z0-9])(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth)[A-Za-z0-9_-]{0,24}+[\x22']?\x20{0,3}+[:=]\x20{0,3}+[\x22']?[A-Za-z0-9+/_.=-]{16,}+"
        r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{36}|xox[a-z]-[A-Za-z0-9-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
        r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        "text rlike '[:=]|AKIA|gh[a-z]_|xox[a-z]-|eyJ|-----BEGIN'",
    ),
}
BASE = ("email", "ip", "card", "phone")
CERTAINTY = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9, "ssn": 0.6, "secret": 0.8}
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte",
    "phone": r"(?i)phone|call|mobile|tel|fax",
    "iban": r"(?i)iban|bank|account|konto|cuenta|compte",
    "ssn": r"(?i)\bssn\b|social|security",
    "secret": r"(?i)login|key|credential|auth",
}


def _luhn(digits: Column) -> Column:
    """Of a string of digits; doubled from the right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count from 10."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(m, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":  # a value of one word isn't a secret
        value = F.regexp_replace(m, r"^[^:=]*[:=]\x20*", "")
        return m.startswith("-----") | value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


def valid(kind: str):
    return lambda x: _valid(kind, x["m"])


def _running(sizes: str) -> str:
    """SQL for the running sums of a non-empty array of whole numbers: within stretches, and of stretches."""
    add = "aggregate({0}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + {1}, 'out', concat(a.out, array(a.at + {2}))), a -> a.out)"
    cut = "transform(sequence(0, (size(y) - 1) DIV CAST(ceil(sqrt(size(y))) AS INT)), c -> slice(y, CAST(c * ceil(sqrt(size(y))) AS INT) + 1, CAST(ceil(sqrt(size(y))) AS INT)))"
    within = f"transform({cut}, w -> {add.format('w', 'x', 'x')})"
    bases = add.format("u", "element_at(x, -1)", "0")
    # arrays of one element bind a name to what is used more than once
    return f"flatten(transform(array({sizes}), y -> flatten(transform(array({within}), u -> flatten(zip_with(u, {bases}, (w, b) -> transform(w, x -> x + b)))))))"


def _spans(k: str, reach: int) -> str:
    """SQL for a kind's matches, with offsets and what stands around."""
    sums = _running("zip_with(_found, slice(_parts, 1, size(_found)), (m, p) -> length(m) + length(p))".replace("_found", f"_found_{k}").replace("_parts", f"_parts_{k}"))
    one = f"named_struct('m', m, 's', z.ends[i] - length(m), 'e', z.ends[i], 'near', concat(right(z.parts[i], {reach}), ' ', left(z.parts[i + 1], {reach})))"
    found = f"transform(array(named_struct('f', _found_{k}, 'parts', _parts_{k}, 'ends', {sums})), z -> transform(z.f, (m, i) -> {one}))[0]"
    return f"CASE WHEN size(_found_{k}) > 0 THEN {found} ELSE cast(array() AS array<struct<m: string, s: int, e: int, near: string>>) END"


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = 40) -> DataFrame:
    """For each row: id, n_<kind> for each kind, n_spans (of all kinds), base_sha256, spans, and scores (as spans, with the score after a colon)."""
    with_column_free(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumns({f"_has_{k}": F.expr(when) for k, (_, when) in PATTERNS.items()})
    rows = rows.withColumns({f"_found_{k}": F.when(F.col(f"_has_{k}"), F.regexp_extract_all("text", F.lit(p), 0)) for k, (p, _) in PATTERNS.items()})
    rows = rows.withColumns({f"_parts_{k}": F.when(F.size(f"_found_{k}") > 0, F.split("text", p, -1)) for k, (p, _) in PATTERNS.items()})
    rows = rows.withColumns({f"_ok_{k}": F.filter(F.expr(_spans(k, reach)), valid(k)) for k in PATTERNS}).select("_id", *[f"_ok_{k}" for k in PATTERNS])

    def name(k: str):
        return lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string"))

    def scored(k: str):
        def one(x: Column) -> Column:
            score = F.least(F.lit(CERTAINTY[k]) + F.when(x["near"].rlike(CONTEXT[k]), 0.3).otherwise(0.0), F.lit(1.0))
            return F.concat_ws(":", name(k)(x), F.format_string("%.2f", score))

        return one

    def joined(kinds, how) -> Column:
        return F.array_join(F.concat(*[F.transform(f"_ok_{k}", how(k)) for k in kinds]), ",")

    counts = {k: F.size(f"_ok_{k}").cast("long") for k in PATTERNS}
    return rows.select(
        F.col("_id").alias(id_column),
        *[c.alias(f"n_{k}") for k, c in counts.items()],
        sum(counts.values(), F.lit(0).cast("long")).alias("n_spans"),
        F.sha2(joined(BASE, name).cast("binary"), 256).alias("base_sha256"),
        joined(PATTERNS, name).alias("spans"),
        joined(PATTERNS, scored).alias("scores"),
    )
