"""PII spans: base patterns, and candidates that gradient boosted trees choose.

All work on texts is done by Spark's own functions in one narrow pass. High-recall
patterns propose spans, which may overlap; format and context features of each go
through boosted trees, compiled to SQL; a span is chosen where its score reaches
its kind's calibrated threshold, it overlaps no base span, and no overlapping
candidate has a higher score. Base spans always stay.

The trees are fitted by the driver on labelled findings (context, match, kind,
label), at most trees.MOST_ROWS of them; by default on findings that are made
here from a fixed seed. Every second finding fits the trees, the others set the
thresholds, at which PRECISION of a kind's chosen findings must be right.

The patterns are those of the contract, written so that no position is tried
twice: a run of characters that the first part takes is entered only at its
begin or where the last match ended.

Defined cases: a null text is empty and has no spans; rows are treated one by one.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common, spans, trees

PRECISION = 0.99
CONTEXT = 32

LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
CANDIDATES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|<at>| at |@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,5}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Words near a candidate that speak for it or against it.
FOR = r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact|mail|reach|write|card|visa|credit|debit|account|iban|bank|ssn|social|security|address|ip|host|customer|patient|name)\b"
AGAINST = r"(?i)\b(?:order|invoice|version|release|isbn|issn|id|item|part|serial|sku|page|figure|table|chapter|date|year|hash|commit|build|score|ratio|total|sum)\b"


# --- base --------------------------------------------------------------------

def ip_valid(m: Column) -> Column:
    def small(p: Column) -> Column:
        plain = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(plain) > 3, False).otherwise(F.coalesce(F.when(plain == "", F.lit(0)).otherwise(plain.try_cast("int")), F.lit(999)) <= 255)

    return F.forall(F.split(m, r"\.", -1), small)


def card_valid(m: Column) -> Column:
    n = F.length(spans.digits(m))
    return F.when((n >= 13) & (n <= 19), spans.luhn(m)).otherwise(False)


def phone_valid(m: Column) -> Column:
    return F.length(spans.digits(m)).between(9, 15)


VALID = {"email": None, "ip": ip_valid, "card": card_valid, "phone": phone_valid}


def base_spans(text: Column) -> list[Column]:
    """array<SPAN> of each base kind. Texts that lack a character the kind needs aren't searched."""
    needs = {"email": "@", "phone": "+"}
    out = []
    for kind, pattern in BASE.items():
        found = spans.find(text, kind, pattern, VALID[kind])
        test = F.contains(text, F.lit(needs[kind])) if kind in needs else F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){12}"))
        out.append(F.when(test, found).otherwise(spans.none()))
    return out


# --- candidates --------------------------------------------------------------

FEATURES = ("kind", "length", "digits", "letters", "upper", "separators", "groups", "paren", "plus", "luhn", "distinct", "known_end", "hidden_at", "leads_zero", "for", "against", "near_for", "glued_left", "glued_right", "year")


def features(m: Column, kind: Column, before: Column, after: Column) -> Column:
    """array<double> in the order of FEATURES."""
    d = spans.digits(m)
    n = F.greatest(F.length(m), F.lit(1))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    is_digits = F.length(d).between(8, 19)
    flags = {
        "kind": number, "length": F.length(m), "digits": F.length(d), "letters": F.regexp_count(m, F.lit("[A-Za-z]")) / n, "upper": F.regexp_count(m, F.lit("[A-Z]")) / n,
        "separators": F.regexp_count(m, F.lit("[^A-Za-z0-9]")), "groups": F.regexp_count(m, F.lit("[0-9]+")), "paren": F.rlike(m, F.lit(r"\([0-9]")), "plus": F.startswith(m, F.lit("+")),
        "luhn": F.when(is_digits, spans.luhn(m)).otherwise(False), "distinct": F.size(F.array_distinct(F.split(d, ""))), "known_end": F.rlike(m, F.lit(r"(?i)(?:\.|dot[)\]]? ?) ?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$")),
        "hidden_at": F.rlike(m, F.lit(r"[(\[{<]at[)\]}>]|@")), "leads_zero": F.startswith(d, F.lit("0")), "for": F.rlike(F.concat(before, F.lit(" "), after), F.lit(FOR)), "against": F.rlike(F.concat(before, F.lit(" "), after), F.lit(AGAINST)),
        "near_for": F.rlike(F.right(before, F.lit(14)), F.lit(FOR)), "glued_left": F.rlike(before, F.lit(r"[A-Za-z0-9_/=#.-]$")), "glued_right": F.rlike(after, F.lit(r"^[A-Za-z0-9_/=#-]")), "year": F.rlike(m, F.lit(r"\b(?:19|20)[0-9]{2}\b")),
    }
    return F.array(*[F.coalesce(flags[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def candidates(text: Column) -> Column:
    """array<SPAN> of all generators; spans of different kinds may overlap."""
    test = {"email": r"(?i)at[)\]}>]| at |@", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"[0-9][) .-]{1,2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"}
    found = [F.when(F.rlike(text, F.lit(test[k])), spans.find(text, k, p)).otherwise(spans.none()) for k, p in CANDIDATES.items()]
    return F.concat(*found)


# --- labelled findings ---------------------------------------------------------

def made_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(before, match, after, kind, label) findings from a fixed seed: personal data in plausible words, and look-alikes."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["an", "the", "re", "ti", "on", "ed", "or", "la", "ch", "en", "ou"]) for _ in range(rng.randint(1, 4)))
    pick = rng.choice

    def check_digit(body: str) -> str:
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def email(good: bool) -> str:
        if good:
            return f"{word()}{pick(['.', '_', ''])}{word()}{pick(['(at)', ' (at) ', '[at]', ' [at] ', '{at}'])}{word()}{pick(['.', ' (dot) ', '[dot]', ' dot '])}{pick(['com', 'org', 'net', 'de', 'fr', 'es', 'edu'])}"
        return f"{word()} at {word()}{pick(['.', ' dot '])}{word().title()}"

    def card(good: bool) -> str:
        full = check_digit(pick("3456") + d(14))
        full = full if good else full[:-1] + str((int(full[-1]) + rng.randint(1, 9)) % 10)
        return pick([full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))])

    def phone(good: bool) -> str:
        if good:
            return pick([f"({d(3)}) {pick('23456789')}{d(2)}-{d(4)}", f"{pick('23456789')}{d(2)}-{pick('23456789')}{d(2)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}"])
        return pick([f"{pick(['19', '20'])}{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.20{d(2)}", f"{d(2)} {d(3)} {d(2)}", f"{d(4)}.{d(4)}.{d(4)}", f"{d(2)}.{d(2)}.{d(3)}"])

    makers = {
        "email": email, "card": card, "phone": phone,
        "ip": lambda good: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)) if good else ":".join(f"{rng.randint(10, 59)}" for _ in range(4)),
        "ssn": lambda good: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" if good else f"000-{d(2)}-{d(4)}",
        "iban": lambda good: pick(["DE", "FR", "ES", "GB"]) + d(2) + " ".join(["", *[d(4) for _ in range(4)]]) + " " + d(2) if good else "".join(pick("ABCDEFGHIJ") for _ in range(2)) + d(2) + "".join(pick("ABCDEF") for _ in range(12)),
    }
    speaks = {"email": ["mail", "contact", "write"], "card": ["card", "visa", "credit"], "phone": ["phone", "tel", "call", "mobile"], "ip": ["ip", "host", "address"], "ssn": ["ssn", "social security"], "iban": ["iban", "bank account"]}
    counter = ["order", "invoice", "version", "isbn", "id", "serial", "date", "build", "page", "total"]
    out = []
    for i in range(n):
        kind, good = KINDS[i % len(KINDS)], rng.random() < 0.5
        # The words beside a finding speak for it, against it or not at all, more or less often by its label; only a number
        # of an ordinary form (phone, ssn) is not called personal for want of them.
        told, ordinary = rng.random(), kind in ("phone", "ssn")
        if good:
            lead = pick(speaks[kind]) if ordinary or told < 0.5 else pick(counter) if told < 0.6 else word()
        else:
            lead = pick(counter) if told < 0.45 else pick(speaks[kind]) if not ordinary and told < 0.65 else word()
        before = f"{word()} {word()} {lead}{pick([':', '', ' is', ' no.'])} "
        match = makers[kind](good or (ordinary and told < 0.5))
        out.append((before, match, f" {word()} {word()}", kind, int(good)))
    return out


FINDINGS = "before string, match string, after string, kind string, label int"


def fit(findings: DataFrame) -> tuple[trees.Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from labelled findings (FINDINGS), of which at most trees.MOST_ROWS by hash are used."""
    rows = findings.select("kind", "label", features(F.col("match"), F.col("kind"), F.col("before"), F.col("after")).alias("f"), F.xxhash64("before", "match", "after", "kind", "label").alias("h"))
    rows = rows.orderBy("h").limit(trees.MOST_ROWS).collect()
    x, y = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows])
    second = np.arange(len(rows)) % 2 == 1
    model = trees.gradient_boosting(x[~second], y[~second])
    score = model.predict(x)
    kinds = np.array([r["kind"] for r in rows])
    return model, {k: trees.threshold_for(score[second & (kinds == k)], y[second & (kinds == k)], PRECISION) for k in KINDS}


# --- operator ------------------------------------------------------------------

def detect(docs: DataFrame, model: trees.Boosted, thresholds: dict[str, float]) -> DataFrame:
    """(doc_id, text, base, chosen): base spans by kind and start, and the spans that the trees add, with their scores."""
    rows = common.documents(docs)
    text = F.col("text")
    rows = rows.withColumns({f"base_{k}": c for k, c in zip(BASE, base_spans(text), strict=True)})
    rows = rows.withColumn("base", F.concat(*[F.col(f"base_{k}") for k in BASE])).withColumn("proposed", candidates(text))
    places = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    apart = spans.let(spans.bounded(places), lambda taken: F.filter("proposed", lambda c: ~spans.overlapping(taken, c)))

    def described(c: Column) -> Column:
        before, after = spans.around(text, c, CONTEXT)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), features(c["m"], c["kind"], before, after).alias("f"))

    rows = rows.withColumn("described", F.transform(apart, described))
    least = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    scored = F.expr(f"transform(described, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'score', {model.sql('c.f')}))")
    rows = rows.withColumn("scored", F.filter(scored, lambda c: c["score"] >= least[c["kind"]]))
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])

    def beaten(rivals: Column, c: Column) -> Column:
        return spans.overlapping(rivals, c, lambda o: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (order[o["kind"]] < order[c["kind"]])))

    chosen = spans.let(spans.bounded(F.col("scored")), lambda rivals: F.filter("scored", lambda c: ~beaten(rivals, c)))
    return rows.select("doc_id", "text", "base", *[F.col(f"base_{k}") for k in BASE], chosen.alias("chosen"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (base and added)."""
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(slim("base"), slim("chosen"))
    by_kind = F.concat(*[F.array_sort(F.filter(every, _is(k))) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in BASE], F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(by_kind).alias("spans"), F.size("chosen").cast("bigint").alias("n_added"), F.size(every).cast("bigint").alias("n_spans"))


def redact(found: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """(doc_id, text) with every span of detect() replaced by its kind; of overlapping base spans the first begun goes before the others."""
    slim = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.array_sort(F.concat(slim("base"), slim("chosen")))
    left, right = mask.split("{kind}")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(left), F.upper(s["kind"]), F.lit(right))
        return F.struct(F.when(free, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(free, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", done.alias("text"))


def default_model(spark: SparkSession) -> tuple[trees.Boosted, dict[str, float]]:
    return fit(spark.createDataFrame(made_findings(), FINDINGS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(common.table(spark, sf_dir, "documents"), *default_model(spark)))
