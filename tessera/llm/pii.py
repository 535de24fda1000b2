"""Personal data: spans by fixed rules, and more by boosted trees over candidates of high recall. DataFrame functions only.

The base finds e-mail and IP addresses, card and phone numbers by rule. Generators with wide patterns propose further, overlapping spans of these and
more kinds: national phone formats, spelled-out e-mail addresses, IPv6, account numbers (IBAN), key-like secrets, social security numbers. Each
candidate has small features of its format (check sums and structure, digits, separators, grouping) and of its context (words that speak for or
against it, edges).

Boosted trees of depth two learn from planted spans: carrier sentences, made by rule, into which spans of every kind are set beside look-alikes
(versions, dates, order numbers, commit hashes, numbers that fail their check sum). Half of them count for the fit, half for the calibration: each kind's
threshold is the smallest score above which at least `PRECISION` of the candidates are planted spans. The model is the same for any corpus, so
a corpus is read once. Candidates above their threshold which no base span overlaps are added; of those that overlap each other the surer one.
"""

from __future__ import annotations

import functools
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the model finds; they follow the base's.
EVERY = (*KINDS, "iban", "secret", "id")
#: The base's patterns. Possessive and bounded on the left where that gives the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns, bounded on both sides or possessive, so that they run in linear time: the kind (None: by format), what must be there, the pattern.
WIDE = {
    "mail": ("email", r"@", r"(?:\G|(?<![^\s@<>()\[\],;:\x22]))[^\s@<>()\[\],;:\x22]++@[^\s@<>()\[\],;:\x22]++"),
    "spelled": ("email", r"(?i)[\[({]at[\])}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[a-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[a-z0-9-]{1,63}){1,4}"),
    "number": (None, r"[0-9](?:[\x20()./-]{0,2}[0-9]){5}", r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){5,39}"),
    "grouped": ("phone", r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "run": ("card", r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "colons": ("ip", r"[0-9A-Fa-f]?:[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])"),
    "account": ("iban", r"[A-Z]{2}[0-9]{2}\x20?[0-9A-Z]{4}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "key": ("secret", r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9])[0-9A-Za-z_/+-]{20}", r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,256}+={0,2}"),
    "dashes": ("id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
}
MARKS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Fixed lists: words before a span that speak for personal data, and against it; beginnings of keys of well-known services.
CUES = r"(?i)(mail|contact|write|call|phone|tel|fax|mobile|card|visa|account|iban|ip|host|server|address|user|login|token|secret|key|password|passwd|pwd|bearer|credential|ssn|social|security|whatsapp|sms|reach|ring)[^A-Za-z0-9]{0,4}$"
AGAINST = r"(?i)(version|release|build|order|invoice|ref|reference|page|pages|isbn|issn|doi|commit|sha|sha1|sha256|md5|checksum|digest|rev|revision|price|total|item|part|article|nr|no|number|lot|batch|since|until|date|time|at|v)[^A-Za-z0-9]{0,4}$"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk_|sk-|pk_|rk_|xox[abp]-|AIza|glpat-|hf_|SG\.|eyJ)"
BEFORE = 24
#: Code points of a piece in which a text that is redacted is cut, so that a place is found without walking there from the beginning.
PIECE = 4096
#: Most spans whose results are kept in the state of one aggregate.
RUN = 64
#: Number of values of each feature; a candidate's features are a row of such small integers.
LEVELS = {"kind": 7, "valid": 4, "digits": 7, "separators": 4, "grouping": 3, "cue": 3, "edge": 2}
ROUNDS, RATE, PRECISION = 60, 0.4, 0.98
#: Planted texts, and the seed of their generator.
PLANTED, SEED = 6000, 5
SPAN = "struct<k:int,start:int,end:int,score:double>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, begin: Column, step: Callable[[Column, Column], Column], put: Callable[[Column, Column], Column], state: str, kind: str) -> Column:
    """The state after all items and the values of type kind that they give, in order: struct (state, out).

    step(state, item) is the next state and put(state, item) an array of what the item adds. An aggregate copies its whole state at each
    step, so more than `RUN` items are taken in runs: first each run's beginning state, then what each run gives.
    """
    none = lambda t: F.expr(f"CAST(array() AS array<{t}>)")
    more = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], put(a["state"], x)).alias("out"))
    one = lambda r, s: F.aggregate(r, F.struct(s.alias("state"), none(kind).alias("out")), more)

    def of(runs: Column) -> Column:
        over = lambda a, r: F.struct(F.aggregate(r, a["state"], step).alias("state"), F.concat(a["all"], F.array(a["state"])).alias("all"))
        both = F.aggregate(runs, F.struct(begin.alias("state"), none(state).alias("all")), over)
        return let(both, lambda a: F.struct(a["state"], F.flatten(F.zip_with(runs, a["all"], lambda r, s: one(r, s)["out"])).alias("out")))

    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    many = let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, RUN)), of)
    return F.when(F.size(items) <= RUN, one(items, begin)).otherwise(many)


def spans(text: Column, pattern: str, mark: str) -> Column:
    """Matches, leftmost and not overlapping: array of (start, end, match, before) in code points; before is the text from the last match on."""
    kind = "array<struct<start:int,end:int,match:string,before:string>>"
    between = F.split(text, pattern, -1)

    def of(found: Column) -> Column:
        return let(F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("match"), F.char_length(m).alias("size"), F.right(b, F.lit(BEFORE)).alias("before"), (F.char_length(b) + F.char_length(m)).alias("step"))), placed)

    def placed(pairs: Column) -> Column:
        ends = let(F.transform(pairs, lambda x: x["step"]), lambda steps: scan(steps, F.lit(0), lambda at, x: at + x, lambda at, x: F.array(at + x), "int", "int"))["out"]
        return F.zip_with(pairs, ends, lambda x, e: F.struct((e - x["size"]).alias("start"), e.alias("end"), x["match"].alias("match"), x["before"].alias("before")))

    return F.when(text.rlike(mark), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(F.expr(f"CAST(array() AS {kind})"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    places = F.sequence(F.lit(1), F.char_length(digits))
    reverse = F.reverse(digits)

    def one(i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(places, F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The base's check of a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans: array of (k, start, end) by kind as listed, then start; k counts the kinds."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(spans(text, BASE[kind], MARKS[kind]), lambda s: holds(kind, s["match"]))
        return F.transform(good, lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def iban_holds(match: Column) -> Column:
    """Whether an account number's check sum is right: letters count as 10 to 35, the first four characters go last, modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def one(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.char_length(plain).between(15, 34) & (F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), one) == 1)


def structure(kind: str, match: Column) -> Column:
    """How well a match is formed, 0 to 3."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "email":
        return F.when(match.rlike(r"(?i)^[^@]+(?:@|\s?[\[({]at[\])}]\s?)[^@]+(?:\.|[\])}]\s?)[a-z]{2,}$"), 2).when(match.rlike(r"@[^@]+\.[^@.]+"), 1).otherwise(0)
    if kind == "ip":
        six = match.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$") | (match.rlike(r"^[0-9A-Fa-f:]*[0-9A-Fa-f]::[0-9A-Fa-f][0-9A-Fa-f:]*$") & ~match.rlike("::.*::"))
        four = match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.left(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
        return F.when(six, 3).when(four, 2).otherwise(0)
    if kind == "card":
        return F.when(n.between(13, 19) & luhn(digits), 3).when(n.between(13, 19), 1).otherwise(0)
    if kind == "phone":
        plus = match.startswith("+") & n.between(9, 15)
        three = match.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}([\x20.-]))[0-9]{3}[\x20.-][0-9]{4}$")
        return F.when(plus, 3).when(three, 2).when(match.rlike(r"^\(?0[0-9]") & n.between(9, 12), 1).otherwise(0)
    if kind == "iban":
        return F.when(iban_holds(match), 3).otherwise(0)
    if kind == "secret":
        mixed = match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9].*[0-9].*[0-9]")
        return F.when(match.rlike(PREFIXES) & match.rlike("[0-9]"), 3).when(match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), 2).when(mixed, 1).otherwise(0)
    return F.when(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 2).otherwise(0)


def candidates(text: Column) -> Column:
    """Proposed spans with features: array of (start, end, kind, valid, digits, separators, grouping, cue, edge); kind counts EVERY."""

    def described(s: Column, only: str | None) -> Column:
        match = s["match"]
        n = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
        if only:
            kind, valid = F.lit(EVERY.index(only)), structure(only, match)
        else:
            dotted, phone = match.rlike(r"^[0-9]+(\.[0-9]+){3}$"), match.rlike(r"[()+]") | (n < 13)
            kind = F.when(dotted, 1).when(phone, 3).otherwise(2)
            valid = F.when(dotted, structure("ip", match)).when(phone, structure("phone", match)).otherwise(structure("card", match))
        level = F.when(n == 0, 0).when(n <= 6, 1).when(n <= 9, 2).when(n <= 12, 3).when(n <= 15, 4).when(n <= 19, 5).otherwise(6)
        separators = F.least(F.regexp_count(match, F.lit(r"[^0-9A-Za-z]+")), F.lit(3))
        even = match.rlike(r"^[0-9]{4}([\x20-][0-9]{4}){3}$|^[^0-9]?[0-9]{1,3}([\x20.-])[0-9]{3}\1[0-9]{4}$|\([0-9]+\)")
        grouping = F.when(even, 2).when(match.rlike(r"[^0-9A-Za-z]"), 1).otherwise(0)
        edge = F.when(F.char_length(s["before"]) == 0, 1).when(F.right(s["before"], F.lit(1)).rlike(r"[\s(\[:,;|<>\x22'=]"), 1).otherwise(0)
        cue = F.when(s["before"].rlike(CUES), 1).when(s["before"].rlike(AGAINST), 2).otherwise(0)
        named = {"kind": kind, "valid": valid, "digits": level, "separators": separators, "grouping": grouping, "cue": cue, "edge": edge}
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[c.cast("int").alias(f) for f, c in named.items()])

    def of(only: str | None, mark: str, pattern: str) -> Column:
        return F.transform(spans(text, pattern, mark), lambda s: described(s, only))

    return F.concat(*[of(*x) for x in WIDE.values()])


def planted(n: int = PLANTED, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts made by rule, and the spans (start, end, kind) that were planted in them; the rest of each are words and look-alikes."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["ka", "lo", "mer", "ti", "san", "vo", "dre", "ul", "pen", "é", "ra"]) for _ in range(rng.randint(1, 4)))
    code = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def checked(k: int, good: bool) -> str:
        body = pick("3456") + digits(k - 2)
        total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body)))
        return body + str((-total + (0 if good else rng.randint(1, 9))) % 10)

    def card(good: bool) -> str:
        c, gap = checked(16, good), pick(["", " ", "-"])
        return pick([gap.join(c[i : i + 4] for i in range(0, 16, 4)), checked(pick([13, 15, 16, 19]), good)])

    def account(good: bool) -> str:
        country, body = pick(["DE", "FR", "GB", "ES", "NL", "IT", "AT"]), pick([digits(18), code("ABCDEFGHIJKLMNOP", 4) + digits(14)])
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        out = f"{country}{(98 - number % 97 + (0 if good else rng.randint(1, 90))) % 97 or 97:02d}{body}"
        return pick([out, " ".join(out[i : i + 4] for i in range(0, len(out), 4))])

    def email() -> str:
        a, b, c = word() + pick(["", ".", "_"]) + pick(["", digits(2)]), word(), pick(["com", "org", "net", "de", "fr"])
        at, dot = pick([(" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", "."), ("@", ".")])
        return (a.strip("._") + at + b + dot + c).replace("é", "e")

    def phone() -> str:
        a, b, c = str(rng.randint(200, 999)), digits(3), digits(4)
        return pick([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)} ({a}) {b}-{c}"])

    def six() -> str:
        part = lambda: code("0123456789abcdef", rng.randint(1, 4))
        return pick([":".join(part() for _ in range(8)), f"2001:db8:{part()}::{part()}", f"fe80::{part()}:{part()}:{part()}"])

    def key() -> str:
        return pick([code("0123456789abcdef", pick([32, 40, 64])), "AKIA" + code("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + digits(1), "ghp_" + code(mixed, 35) + digits(1), "sk_" + "live_" + code(mixed, 23) + digits(1), code(mixed, rng.randint(28, 44)) + digits(3)])

    four = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    person = lambda: f"{pick([rng.randint(1, 665), rng.randint(667, 899)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    sure = {0: (email, ["mail ", "write to ", "contact: ", ""]), 1: (lambda: pick([four, six])(), ["host ", "server ", "ip: ", ""]), 2: (lambda: card(True), ["card ", "visa: ", ""]), 3: (phone, ["call ", "phone: ", "tel. ", "mobile ", ""]), 4: (lambda: account(True), ["iban ", "account ", ""]), 5: (key, ["token = \"", "api_key: ", "password=", "secret ", "bearer "]), 6: (person, ["ssn ", "social security ", "SSN: ", ""])}
    bare = [(3, lambda: digits(10), ["phone ", "call ", "mobile: "]), (3, lambda: "0" + digits(3) + pick([" ", "/", "-"]) + digits(6), ["phone ", "tel: ", "fax "])]
    alike = [
        (lambda: f"{rng.randint(1, 12)}.{rng.randint(0, 40)}.{rng.randint(0, 99)}", ["version ", "release ", "v", ""]), (lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", ["since ", "date: ", ""]),
        (lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", ["at ", "time ", ""]), (lambda: digits(rng.randint(6, 12)), ["order ", "invoice ", "item ", "", "no. "]), (lambda: digits(rng.randint(13, 24)), ["order ", "ref ", ""]),
        (lambda: card(False), ["card ", "item ", "order ", ""]), (lambda: account(False), ["ref ", "iban ", ""]), (lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", ["isbn ", ""]), (lambda: code("0123456789abcdef", pick([32, 40, 64])), ["commit ", "sha256: ", "md5 ", "digest ", ""]),
        (lambda: "".join(word().replace("é", "e") for _ in range(8)), ["", "token "]), (lambda: f"{rng.randint(0, 9)}.{digits(rng.randint(6, 15))}", ["total ", "price ", ""]), (lambda: f"{digits(3)} {digits(3)} {digits(3)}", ["total ", "price ", ""]), (lambda: f"{word()}@{word()}", ["", "at "]),
        (lambda: f"{pick(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}", ["no. ", "part "]), (lambda: "/".join(word().replace("é", "e") for _ in range(6)) + digits(1), ["", "page "]), (lambda: ".".join(str(rng.randint(300, 9999)) for _ in range(4)), ["version ", ""]), (lambda: "1 2 3 4 5 6 7 8", [""]), (lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2030)}", ["since ", "on ", ""]), (lambda: f"{digits(4)}-{digits(3)}-{digits(3)}", ["part ", "item ", ""]),
    ]
    out = []
    for i in range(n):
        text, found = " ".join(word() for _ in range(rng.randint(1, 4))) + " ", []
        if i % 2 == 0:
            kind, make, cues = pick([(k, *x) for k, x in sure.items()] * 2 + bare)
            lead, span = pick(cues), make()
            found.append((len(text + lead), len(text + lead + span), kind))
        else:
            make, cues = pick(alike)
            lead, span = pick(cues), make()
        closing = '"' if lead.endswith('"') else pick(["", ".", ",", ""])
        out.append((text + lead + span + closing + " " + " ".join(word() for _ in range(rng.randint(1, 3))), found))
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted trees: (first split, splits below, values), and each kind's threshold; None adds nothing."""

    prior: float
    trees: tuple[tuple[tuple[str, int], tuple[tuple[str, int] | None, ...], tuple[float, ...]], ...]
    thresholds: tuple[float | None, ...]

    def of(self, x: dict[str, int]) -> float:
        total = self.prior
        for (f, v), below, values in self.trees:
            side = int(x[f] > v)
            low = below[side]
            total += values[2 * side + (int(x[low[0]] > low[1]) if low else 0)]
        return total

    def column(self, s: Column) -> Column:
        total = F.lit(self.prior)
        for (f, v), below, values in self.trees:
            side = [F.lit(values[2 * i]) if b is None else F.when(s[b[0]] > b[1], values[2 * i + 1]).otherwise(values[2 * i]) for i, b in enumerate(below)]
            total = total + F.when(s[f] > v, side[1]).otherwise(side[0])
        return total

    def limit(self, kind: Column) -> Column:
        """The least score of a kind."""
        out = F.lit(None).cast("double")
        for k, t in enumerate(self.thresholds):
            if t is not None:
                out = F.when(kind == k, F.lit(t)).otherwise(out)
        return out


def boost(cells: list[tuple[dict[str, int], float, float]]) -> tuple[float, tuple]:
    """Gradient boosting with the logistic loss over cells (features, rows, positives)."""
    rows, positives = sum(n for _, n, _ in cells), sum(p for _, _, p in cells)
    prior = math.log((positives + 1) / (rows - positives + 1))
    f = [prior] * len(cells)
    splits = [(name, v) for name, n in LEVELS.items() for v in range(n - 1)]

    def sums(own, g, h):
        return sum(g[i] for i in own), sum(h[i] for i in own)

    def best(own, g, h):
        top, found = 1e-6, None
        total = sums(own, g, h)
        for name, v in splits:
            right = [i for i in own if cells[i][0][name] > v]
            if right and len(right) < len(own):
                a = sums(right, g, h)
                b = (total[0] - a[0], total[1] - a[1])
                gain = a[0] ** 2 / (a[1] + 1) + b[0] ** 2 / (b[1] + 1) - total[0] ** 2 / (total[1] + 1)
                if gain > top:
                    top, found = gain, (name, v)
        return found

    trees = []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in f]
        g = [c[2] - c[1] * q for c, q in zip(cells, p, strict=True)]
        h = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        first = best(range(len(cells)), g, h)
        if first is None:
            break
        below, values, members = [], [], []
        for side in (0, 1):
            own = [i for i, c in enumerate(cells) if int(c[0][first[0]] > first[1]) == side]
            low = best(own, g, h)
            below.append(low)
            for leaf in (0, 1):
                mine = [i for i in own if low and int(cells[i][0][low[0]] > low[1]) == leaf] if low else (own if leaf == 0 else [])
                a, b = sums(mine, g, h)
                values.append(RATE * a / (b + 1))
                members.append(mine)
        for value, mine in zip(values, members, strict=True):
            for i in mine:
                f[i] += value
        trees.append((first, tuple(below), tuple(values)))
    return prior, tuple(trees)


def counted(rows: DataFrame) -> list[dict[tuple, list[float]]]:
    """By fold, candidates and planted spans among them by their features; rows: fold, t, truth (start, end, kind)."""
    one = rows.select("fold", "truth", F.explode(candidates(F.col("t"))).alias("s"))
    good = F.exists("truth", lambda b: (b["kind"] == F.col("s")["kind"]) & (b["start"] == F.col("s")["start"]) & (b["end"] == F.col("s")["end"]))
    tables: list[dict[tuple, list[float]]] = [{}, {}]
    for r in one.select("fold", good.alias("good"), *[F.col("s")[f].alias(f) for f in LEVELS]).groupBy("fold", "good", *LEVELS).count().collect():  # by features
        cell = tables[r["fold"]].setdefault(tuple(r[f] for f in LEVELS), [0.0, 0.0])
        cell[0] += r["count"]
        cell[1] += r["count"] * r["good"]
    return tables


def calibrated(model: Trees, cells: list[tuple[dict[str, int], float, float]]) -> tuple[float | None, ...]:
    """Each kind's smallest score above which at least PRECISION of the candidates are planted spans; None if there is none."""
    thresholds: list[float | None] = []
    for k in range(len(EVERY)):
        scored = sorted(((model.of(x), n, p) for x, n, p in cells if x["kind"] == k), key=lambda c: -c[0])
        n = p = 0.0
        found = None
        for i, (score, rows, good) in enumerate(scored):
            n, p = n + rows, p + good
            if (i + 1 == len(scored) or scored[i + 1][0] < score - 1e-9) and p >= PRECISION * n:
                found = score - 1e-9
        thresholds.append(found)
    return tuple(thresholds)


@functools.cache
def learnt() -> Trees:
    """The model; it is fitted once a process, on planted texts in the active session, and depends on nothing else."""
    spark = SparkSession.active()
    rows = [{"fold": i // 2 % 2, "t": t, "truth": [{"start": a, "end": b, "kind": k} for a, b, k in found]} for i, (t, found) in enumerate(planted())]
    parts = [json.dumps(rows[i : i + 500]) for i in range(0, len(rows), 500)]
    kind = "array<struct<fold:int,t:string,truth:array<struct<start:int,end:int,kind:int>>>>"
    texts = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in parts])).alias("j")).select(F.inline(F.from_json("j", kind)))
    cells = [[(dict(zip(LEVELS, key, strict=True)), n, p) for key, (n, p) in sorted(t.items())] for t in counted(texts)]
    prior, trees = boost(cells[0])
    model = Trees(prior, trees, (None,) * len(EVERY))
    return Trees(prior, trees, calibrated(model, cells[1]))


def added(base: Column, proposed: Column, model: Trees) -> Column:
    """Proposed spans that the model is sure of: none that overlaps a base span, and of those that overlap each other, from left to right, the
    one of higher score (the earlier one on ties). Array of (k, start, end, score)."""
    scored = F.transform(proposed, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s["kind"].alias("k"), model.column(s).alias("score")))
    sure = F.filter(scored, lambda s: F.coalesce(s["score"] >= model.limit(s["k"]), F.lit(False)))
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), b["k"].alias("k"), F.lit(0.0).alias("score")))
    none, empty = F.lit(None).cast(SPAN), F.expr(f"CAST(array() AS array<{SPAN}>)")

    def overlaps(a: Column, x: Column) -> Column:
        return F.coalesce(x["start"] < a["held"]["end"], F.lit(False))

    def step(a: Column, x: Column) -> Column:
        held, rule = a["held"], x["own"] == 0
        mine = F.struct(x["k"], x["start"], x["end"], x["score"]).cast(SPAN)
        stays = F.when(rule, none).when(x["start"] < a["edge"], F.when(overlaps(a, x), held).otherwise(none)).when(overlaps(a, x) & (held["score"] >= x["score"]), held).otherwise(mine)
        return F.struct(F.when(rule, F.greatest(a["edge"], x["end"])).otherwise(a["edge"]).alias("edge"), stays.alias("held"))

    def put(a: Column, x: Column) -> Column:
        return F.when(a["held"].isNotNull() & ~overlaps(a, x), F.array(a["held"])).otherwise(empty)

    def swept(sure: Column) -> Column:
        begin = F.struct(F.lit(0).alias("edge"), none.alias("held"))
        every = let(F.array_sort(F.concat(fixed, sure)), lambda items: scan(items, begin, step, put, f"struct<edge:int,held:{SPAN}>", SPAN))
        last = lambda a: F.concat(a["out"], F.when(a["state"]["held"].isNotNull(), F.array(a["state"]["held"])).otherwise(empty))
        return F.when(F.size(sure) > 0, let(every, last)).otherwise(empty)

    return let(sure, swept)


@functools.lru_cache(maxsize=8)
def expressions(application: str, model: Trees) -> tuple[Column, Column, Column]:
    """Base spans and candidates of the column t_, and from both, as columns base_ and wide_, the added spans: array of (k, start, end). They have
    tens of thousands of nodes, which take seconds to put together, so an application does that once."""
    del application
    new = F.transform(added(F.col("base_"), F.col("wide_"), model), lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    return base_spans(F.col("t_")), candidates(F.col("t_")), new


def with_spans(docs: DataFrame, model: Trees, text: Column) -> DataFrame:
    """docs with base_ and added_, arrays of (k, start, end)."""
    base, wide, new = expressions(docs.sparkSession.sparkContext.applicationId, model)
    return docs.withColumn("t_", text).withColumn("base_", base).withColumn("wide_", wide).withColumn("added_", new).drop("wide_", "t_")


def written_spans(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Trees | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans.

    Null texts are empty: no spans. Offsets are code points, end exclusive. Repeated rows give repeated rows; other columns are not looked at.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    found = with_spans(own, model or learnt(), F.col("t")).drop("t")

    def count_of(k: int) -> Column:
        return F.size(F.filter("base_", lambda b: b["k"] == k)).cast("long")

    count = [count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("base_", "added_"))
    sizes = [F.size("added_").cast("long").alias("n_added"), (F.size("base_") + F.size("added_")).cast("long").alias("n_spans")]
    return found.select("doc_id", *count, F.sha2(written_spans(F.col("base_")), 256).alias("base_sha256"), written_spans(every).alias("spans"), *sizes)


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is cut into pieces of PIECE; start is at most end."""
    first, last, skipped = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int"), start % PIECE + 1
    whole = F.concat(F.substring(F.get(pieces, first), skipped, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.coalesce(F.substring(F.get(pieces, last), F.lit(1), end % PIECE), F.lit("")))
    return F.when(start >= end, F.lit("")).when(first == last, F.substring(F.get(pieces, first), skipped, end - start)).otherwise(whole)


def redact(docs: DataFrame, model: Trees | None = None, text: str = "text") -> DataFrame:
    """docs with every span of its text, base or added, replaced by its kind in brackets; overlapping spans are replaced by the first one's.

    Null texts stay null; columns and rows are as before, but n_chars, if there is such a column, is the new text's length. Columns may have any
    names; repeated rows and empty tables are like others.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text)}"
    t = F.col(at).cast("string")
    found = with_spans(own, model or learnt(), F.coalesce(t, F.lit("")))
    order = F.array_sort(F.transform(F.concat("base_", "added_"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in EVERY])


    def renewed(items: Column, pieces: Column) -> Column:
        """What is between the spans and their tags; each span is held against the furthest end before it."""
        furthest = lambda at, x: F.greatest(at, x["end"])
        ends = scan(items, F.lit(0), furthest, lambda at, x: F.array(at), "int", "int")
        piece = lambda x, at: F.when(x["start"] >= at, F.concat(between(pieces, at, x["start"]), F.element_at(tags, x["k"] + 1))).otherwise("")
        return let(ends, lambda a: F.concat(F.array_join(F.zip_with(items, a["out"], piece), ""), between(pieces, a["state"], F.char_length(t))))

    some = F.size("base_") + F.size("added_") > 0
    new = found.withColumn(at, F.when(some, let(order, lambda items: let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: renewed(items, pieces)))).otherwise(t))
    columns = [F.char_length(F.col(at)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return new.select(*columns)
