"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers.

Candidates are the strict spans of each kind and loose ones: obfuscated addresses, IPv6 and dotted
numbers out of range, card-like digits with a wrong check digit, national and bare phone numbers,
key-like strings, bank accounts, identity numbers, names and street addresses. Many of them are no
personal data, so the labelers have something to disagree on. Five labelers - form, checksum or range,
gazetteer, context words, shape - vote for, against or not at all. The votes of all documents are
counted by pattern (a few thousand at most, whatever the corpus); expectation-maximisation on these
counts estimates how reliable each labeler is, and a logistic span classifier is trained on the
resulting labels. Strict spans always stay; the classifier decides on the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import let

# Fixed values.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "id", "name", "address")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Runs are possessive and start where a run can start, so that no text is scanned twice. A card
#: needs 16 digits, and its run is as long as it gets, so shorter runs are left out from the start.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square|Terrace"
TITLE = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Se\u00f1ora?|Sra?"
LOOSE = {
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]++){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,5}(?:\.[0-9]{1,5}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{9,12}+)(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?=[A-Z])(?<![\p{{L}}])(?:(?:{TITLE})\.?\x20)?[A-Z][a-z]++(?:\x20[A-Z][a-z]++){{1,2}}(?![\p{{L}}])",
    "address": rf"(?<![0-9])[0-9]{{1,5}}\x20(?:[A-Z][a-z]++\x20){{1,3}}(?:{STREET})\b"
    r"|(?<![\p{L}])[A-Z][a-z\u00e4\u00f6\u00fc]{2,30}?(?:stra\u00dfe|strasse|gasse|platz)\x20[0-9]{1,4}(?![0-9])",
}
#: What a text must hold for the pattern to be worth a look.
HINT = {
    ("email", 1): "@", ("ip", 1): r"[0-9]\.[0-9]+\.[0-9]", ("card", 1): r"[0-9](?:[\x20-]?[0-9]){15}",
    ("phone", 1): r"\+[0-9]", ("email", 0): r"[\x20(\[{]dot", ("ip", 0): r"(?:[0-9A-Fa-f]{1,4}:){7}|[0-9]\.[0-9]+\.[0-9]",
    ("card", 0): r"[0-9](?:[\x20-]?[0-9]){12}", ("phone", 0): r"[0-9]{3}[\x20.-][0-9]{4}|[0-9]{9}",
    ("secret", 0): r"[0-9][A-Za-z]|[A-Za-z][0-9]", ("iban", 0): r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", ("id", 0): r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    ("name", 0): r"[A-Z][a-z]++\.?\x20[A-Z][a-z]",
    ("address", 0): rf"[a-z]\x20(?:{STREET})\b|(?:stra\u00dfe|strasse|gasse|platz)\x20[0-9]",
}
#: Kinds of which every span holds a digit, so that most texts need one look for all of them.
WITH_DIGITS = {"ip", "card", "phone", "secret", "iban", "id", "address"}
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Mark|Paul|Andrew|George|Peter"
    "|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Lisa|Nancy|Anna|Laura|Emma|Julia|Alice"
    "|Hans|Klaus|Stefan|Wolfgang|Ursula|Monika|Sabine|Petra|Heike|Pierre|Jean|Michel|Philippe|Marie|Nathalie|Isabelle"
    "|Sophie|Jose|Juan|Antonio|Francisco|Carlos|Luis|Carmen|Ana|Isabel|Pilar|Lucia|Ali|Mohammed|Fatima|Wei|Yuki|Ivan|Olga"
)
#: Firm forms of the loose kinds; a strict span has its form by itself.
FORM = {
    "email": r"[(\[{]at[)\]}]",
    "ip": r":",
    "card": r"^3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}$",
    "phone": r"^\([0-9]{3}\)|^[0-9]{3}([\x20.-])[0-9]{3}\1",
    "secret": r"^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-.{20}|xox[abp]-.{10,}|sk[-_].{16,}|AIza.{35}"
    r"|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{16,}$",
    "id": r"-",
    "name": rf"^(?:{TITLE})\.?\x20",
    "address": r"^[1-9]|\x20[1-9]",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]}]?\x20?)(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us|ca|ch|at|it|nl)$",
    "ip": r"(?i)^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|fe80:|fd|2001:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|33|34|49|44|39|41|43)[^0-9]|^\(?(?:800|888|877|555)\)?",
    "secret": r"^(?:A[KS]IA|gh[pousr]_|glpat-|xox[abp]-|sk[-_]|AIza|eyJ)",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "id": r"^(?!000|666|9)[0-9]",
    "name": rf"\b(?:{GIVEN})\b",
    "address": rf"\b(?:{STREET})$|stra(?:\u00df|ss)e",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial)\b",
    "secret": r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|bearer|credential)",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta|transfer)\b",
    "id": r"(?i)\b(?:ssn|social security|tax id|national id|passport)\b",
    "name": r"(?i)\b(?:name|contact|signed|dear|author|patient|customer|employee)\b",
    "address": r"(?i)\b(?:address|live[sd]?|resid\w+|ship|deliver|home|wohnt|adresse)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|serial|part|ref|doi|total|commit|sha[0-9]*|md5|checksum|uuid|digest|build)\b"
SHAPE = {
    "email": r"^[A-Za-z]",
    "ip": r"^[0-9.]{7,15}$|:",
    "card": r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){2}|^3[47][0-9]{2}[\x20-]?[0-9]{6}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}$|\([0-9]{2,4}\)",
    "secret": r"(?:[A-Za-z]+[0-9]+){4}",
    "iban": r"^.{15,42}$",
    "id": r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"(?:son|sen|man|mann|er|ez|ski|ini|ton|ley|ard|ier)$",
    "address": r"^[0-9]{1,4}\x20|[0-9]{1,3}$",
}
#: Shapes that speak against a kind: one character over and over, bare digits as a phone number,
#: words joined by hyphens or slashes as a key, words that begin like names.
MISSHAPEN = {
    "phone": r"^[0-9]++$",
    "secret": r"^[A-Za-z]+(?:[_/-][A-Za-z]+)*[_/-]?[0-9]{0,4}$|^[0-9_/+-]*[A-Za-z]{0,2}[0-9_/+-]*$",
    "name": r"^(?:The|A|An|In|On|At|Of|And|For|New|North|South|East|West|United|Monday|Tuesday|Wednesday|Thursday|Friday"
    r"|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December)\x20",
}

LABELERS = ("form", "check", "gazetteer", "context", "shape")
CONTEXT_CHARS = 40
#: Values scanned one after the other before the results are put together.
SCAN = 128
#: Code points per part of a text that is cut many times.
CUT = 4096
SPANS = "array<struct<start:int,end:int,found:string,near:string>>"


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (ints) what ``combine`` makes of 0 and all values before it.

    ``combine`` is associative. Arrays grow within blocks only, so the time is not quadratic.
    """

    def scan(items: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            items, start,
            lambda acc, v: F.struct(combine(acc["at"], v).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

    def blocks(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(every), F.lit(SCAN)), lambda i: F.slice(every, i, SCAN))

        def put(cut: Column) -> Column:
            totals = F.transform(cut, lambda part: F.aggregate(part, F.lit(0), lambda acc, v: combine(acc, v).cast("int")))
            starts = let(totals, lambda t: scan(t, F.lit(0)))
            return F.flatten(F.zip_with(cut, starts, scan))

        return let(parts, put)

    return F.when(F.size(values) > 0, let(values, blocks)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` from the left as (start, end, found, near), in code points.

    ``near`` is the text before the match, back to the match before and at most ``CONTEXT_CHARS``.
    """

    def place(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        widths = F.transform(found, lambda f, i: F.char_length(gaps[i]) + F.char_length(f))

        def spans(before: Column) -> Column:
            def span(f: Column, i: Column) -> Column:
                start = before[i] + F.char_length(gaps[i])
                return F.struct(
                    start.alias("start"), (start + F.char_length(f)).alias("end"), f.alias("found"),
                    F.substring(gaps[i], -CONTEXT_CHARS, CONTEXT_CHARS).alias("near"),
                )

            return F.transform(found, span)

        return let(before_each(widths, lambda a, b: a + b), spans).cast(SPANS)

    both = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return let(both, place)


def _replaced(text: Column, ordered: Column, stand_in: Callable[[Column], Column]) -> Column:
    """The text with each run of overlapping spans replaced by the stand-in of its first one.

    ``ordered`` is not empty and ordered by start. Pieces are cut from parts of ``CUT`` code points.
    """

    def joined(both: Column) -> Column:
        spans, parts = both["spans"], both["parts"]

        def cut(start: Column, stop: Column) -> Column:
            first = F.floor(start / CUT).cast("int")
            some = F.array_join(F.slice(parts, first + 1, F.floor(stop / CUT).cast("int") - first + 1), "")
            return F.when(stop > start, F.substring(some, start - first * CUT + 1, stop - start)).otherwise("")

        def pieces(upto: Column) -> Column:
            kept = F.transform(
                spans,
                lambda s, i: F.when((i == 0) | (s["start"] >= upto[i]), F.concat(cut(upto[i], s["start"]), stand_in(s))).otherwise(""),
            )
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(kept, ""), cut(last, F.greatest(F.char_length(text), last)))

        return let(before_each(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), pieces)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return let(F.struct(ordered.alias("spans"), parts.alias("parts")), joined)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _strictly(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _worth(text: Column, kind: str, strict: int, digits: Column | None) -> Column:
    """Whether a text may hold spans of the kind; ``digits`` says whether it has any digit."""
    hinted = text.rlike(HINT[kind, strict])
    return digits & hinted if digits is not None and kind in WITH_DIGITS else hinted


def strict_spans(text: Column, kind: str, digits: Column | None = None) -> Column:
    """Matches of the strict pattern that hold; a failing match is dropped and not tried again."""
    found = F.filter(located(text, STRICT[kind]), lambda s: _strictly(kind, s["found"]))
    return F.when(_worth(text, kind, 1, digits), found).otherwise(F.array().cast(SPANS))


def _mod_97(found: Column) -> Column:
    """The rest of a bank account number by 97, letters as two digits, its first four characters last."""
    plain = F.regexp_replace(found, "\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def _checked(kind: str, found: Column) -> Column:
    """The vote of the checksum, the range or the variety of characters."""
    yes = lambda ok: F.when(ok, 1).otherwise(-1)
    if kind == "card":
        return yes(luhn(_digits(found)))
    if kind == "phone":
        return yes(F.length(_digits(found)).between(8, 15) & ~found.rlike("^0*$"))
    if kind == "ip":
        return yes(found.contains(":") | (found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$") & ~found.startswith("0.")))
    if kind == "secret":
        return yes(F.size(F.array_distinct(F.split(found, ""))) >= 9)
    if kind == "iban":
        return yes(_mod_97(found) == 1)
    if kind == "id":
        return yes(~found.rlike(r"^(?:000|666|9)|-00-|-0000$"))
    if kind == "name":  # no checksum: only repeated words and overlong runs speak against it
        return F.when(found.rlike(r"\b(\w+)\x20\1\b") | (F.char_length(found) > 40), -1).otherwise(0)
    return F.when(F.char_length(found) <= 254, 0).otherwise(-1)


def _votes(kind: str, span: Column, strict: bool) -> list[Column]:
    found, near = span["found"], span["near"]
    form = F.lit(1) if strict else F.when(found.rlike(FORM[kind]), 1).otherwise(0)
    misshapen = found.rlike(r"^(.)\1*$")
    if kind in MISSHAPEN and not strict:
        misshapen = misshapen | found.rlike(MISSHAPEN[kind])
    return [
        form,
        _checked(kind, found),
        F.when(found.rlike(GAZETTEER[kind]), 1).otherwise(0),
        F.when(near.rlike(CONTEXT[kind]), 1).when(near.rlike(AGAINST), -1).otherwise(0),
        F.when(misshapen, -1).when(found.rlike(SHAPE[kind]), 1).otherwise(0),
    ]


def _described(number: int, strict: bool):
    def describe(span: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            F.lit(strict).alias("strict"),
            *[v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(KINDS[number], span, strict))],
            F.least(F.floor((span["end"] - span["start"]) / 8), F.lit(5)).cast("int").alias("length"),
        )

    return describe


def _found_by_kind(number: int, kind: str, text: Column, digits: Column) -> Column:
    """The described strict and loose spans of one kind; loose ones are sought outside the strict ones."""

    def both(strict: Column | None) -> Column:
        blank = lambda s: F.repeat(F.lit("\n"), s["end"] - s["start"])
        rest = text if strict is None else F.when(F.size(strict) > 0, _replaced(text, strict, blank)).otherwise(text)
        loose = let(rest, lambda t: F.transform(located(t, LOOSE[kind]), _described(number, False)))
        none = F.slice(F.transform(F.array().cast(SPANS), _described(number, False)), 1, 1)
        loose = F.when(_worth(text, kind, 0, digits), loose).otherwise(none)
        return loose if strict is None else F.concat(F.transform(strict, _described(number, True)), loose)

    return let(strict_spans(text, kind, digits), both) if kind in STRICT else both(None)


def _candidates(df: DataFrame, text: str, name: str = "_pii") -> DataFrame:
    """Adds ``name``: (kind number, start, end, strict, one vote per labeler, size class) of each candidate."""
    whole = F.coalesce(F.col(text), F.lit(""))
    looked = F.struct(whole.alias("text"), whole.rlike("[0-9]").alias("digits"))
    return df.withColumn(
        name, let(looked, lambda t: F.concat(*[_found_by_kind(n, kind, t["text"], t["digits"]) for n, kind in enumerate(KINDS)]))
    )


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier and the reliabilities behind it."""

    offset: float = -0.5
    votes: tuple[float, ...] = (1.0,) * len(LABELERS)
    kinds: tuple[float, ...] = (0.0,) * len(KINDS)
    length: float = 0.0
    reliability: dict = field(default_factory=dict)


def estimate(counts: list[tuple[int, tuple[int, ...], float]], rounds: int = 60):
    """EM on (kind, votes, count): the chance that each pattern is personal data, and P(vote | class).

    Labelers are independent given the class; each kind has its own share of true spans.
    """
    belief = [1 / (1 + math.exp(-1.5 * (sum(votes) - 1))) for _, votes, _ in counts]
    rates = {}
    for _ in range(rounds):
        share = {k: [1.0, 1.0] for k in range(len(KINDS))}
        # A few votes beforehand: a labeler is more often right than wrong until the table says otherwise.
        seen = {(j, v, c): 2.0 + (v if c else -v) for j in range(len(LABELERS)) for v in (-1, 0, 1) for c in (0, 1)}
        for (kind, votes, n), p in zip(counts, belief):
            for c, weight in ((1, p * n), (0, (1 - p) * n)):
                share[kind][c] += weight
                for j, v in enumerate(votes):
                    seen[j, v, c] += weight
        # A vote for a span is never taken as a sign against it.
        rates = {}
        for j in range(len(LABELERS)):
            for c in (0, 1):
                total = sum(seen[j, v, c] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    rates[j, v, c] = seen[j, v, c] / total
            if rates[j, 1, 1] < rates[j, 1, 0]:
                rates[j, 1, 1] = rates[j, 1, 0]
        belief = []
        for kind, votes, _ in counts:
            odds = math.log(share[kind][1] / share[kind][0])
            odds += sum(math.log(rates[j, v, 1] / rates[j, v, 0]) for j, v in enumerate(votes))
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return belief, rates


def fit(df: DataFrame, text: str = "text") -> Model:
    """Counts the vote patterns of all texts, estimates the labelers and trains the classifier."""
    import numpy as np

    spans = _candidates(df.select(text), text).select(F.explode("_pii").alias("c"))
    table = (  # at most kinds x 3^labelers x size classes rows, whatever the corpus
        spans.groupBy("c.kind", *[f"c.{n}" for n in LABELERS], "c.length").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", *LABELERS, "length").collect()
    )
    if not table:
        return Model()
    counts = [(r.kind, tuple(r[n] for n in LABELERS), float(r.n)) for r in table]
    belief, rates = estimate(counts)
    x = np.array([[1.0, *votes, *(float(kind == k) for k in range(len(KINDS))), float(r.length)]
                  for (kind, votes, _), r in zip(counts, table)])
    n, aim, w = np.array([c for _, _, c in counts]), np.array(belief), np.zeros(x.shape[1])
    n = n / n.sum() * len(n)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.clip(np.linalg.solve(hessian, x.T @ (n * (aim - p)) - 0.05 * w), -2, 2)
    k = len(LABELERS)
    reliability = {name: rates[j, 1, 1] / (rates[j, 1, 1] + rates[j, 1, 0]) for j, name in enumerate(LABELERS)}
    return Model(float(w[0]), tuple(map(float, w[1 : k + 1])), tuple(map(float, w[k + 1 : -1])), float(w[-1]), reliability)


def annotate(df: DataFrame, model: Model, text: str = "text", name: str = "pii") -> DataFrame:
    """``df`` with ``name``: array of (kind, start, end, strict), by kind and start; replaces such a column.

    Offsets are code points, ends exclusive. Null and empty texts have no spans, an empty table gives
    an empty one, equal texts equal spans, and repeated rows stay. Texts are searched whole, in time
    that does not grow with the square of their matches. Strict spans of a kind do not overlap, and
    loose ones do not overlap them; spans of different kinds may.
    """

    def chance(c: Column) -> Column:
        z = F.lit(model.offset) + F.lit(model.length) * c["length"]
        for weight, labeler in zip(model.votes, LABELERS):
            z = z + F.lit(weight) * c[labeler]
        return z + F.element_at(F.array(*map(F.lit, model.kinds)), c["kind"] + 1)

    kept = F.array_sort(F.filter(name, lambda c: c["strict"] | (chance(c) >= 0)))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        kept, lambda c: F.struct(kinds[c["kind"]].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                                 c["strict"].alias("strict"))
    )
    return _candidates(df, text, name).withColumn(name, spans)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its kind, such as ``[EMAIL]``."""

    by_start = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    kind_of = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    return F.when(F.size(spans) > 0, let(by_start, lambda ordered: _replaced(text, ordered, kind_of))).otherwise(text)


def span_digest(annotated: DataFrame, name: str = "pii") -> DataFrame:
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    strict = F.filter(name, lambda s: s["strict"])
    kinds = F.transform(strict, lambda s: s["kind"])
    counted = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS
    ]
    return annotated.select(
        "doc_id", *counted, F.sha2(listed(strict), 256).alias("base_sha256"), listed(F.col(name)).alias("spans")
    )
