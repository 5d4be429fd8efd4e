"""Secret scan: candidates by pattern, false positives removed by a random forest.

All work on texts is done by Spark's own functions in one narrow pass. Patterns
propose candidates: runs of characters that keys are made of, values assigned to
names that speak of secrets, and private key blocks. The forest, compiled to SQL,
looks at each one's length, the transitions between its characters (changes of
their class, and how likely the corpus's words make each pair of letters), how far a
dictionary covers it, the path it stands in (of the row, and in the text around
it) and the words beside it. A candidate whose score reaches THRESHOLD is a secret.

The forest is fitted by the driver on labelled findings (before, match, after,
path, label), at most trees.MOST_ROWS of them, which go through the same patterns
as the texts; by default on findings that are made here from a fixed seed. The
dictionary is the DICTIONARY most frequent words of four letters or more in the
corpus, and the letter pairs are those of all its words, both counted over all rows.

Defined cases: a null text is empty and has no candidates; a null path is empty;
rows are treated one by one.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import common, spans, trees

THRESHOLD = 0.5
CONTEXT = 40
DICTIONARY = 2000
#: Lengths of the words that the dictionary is asked for.
SHORTEST, LONGEST = 4, 14

#: A run of characters that keys are made of, of 16 characters or more; the name before a sign of assignment is a run of its own.
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_.-]))[A-Za-z0-9+/_.-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=.-]))?"
#: What is assigned to a name that speaks of a secret, of any characters; and a private key.
ASSIGNED = r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?)[^\s\"',;:=][^\s\"',;]{5,}"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{1,8000}-----END [A-Z ]{0,20}PRIVATE KEY-----"
PATTERNS = {"token": (TOKEN, r"[A-Za-z0-9+/_.-]{16}"), "assigned": (ASSIGNED, r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ ]{0,2}[:=]"), "pem": (PEM, "PRIVATE KEY-----")}
FOR = r"(?i)(?:secret|token|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?id)"
AGAINST = r"(?i)(?:commit|sha-?[0-9]*|md5|hash|checksum|digest|integrity|uuid|guid|etag|revision|blob|example|sample|placeholder|dummy|changeme|trace|version|build|license)"
PLAIN_PATH = r"(?i)(?:test|spec|example|mock|fixture|sample|docs?/|readme|\.lock|lock\.json|node_modules|vendor)"
SECRET_PATH = r"(?i)(?:\.env|config|settings|credential|secret|\.pem|\.key|deploy)"

FEATURES = ("kind", "length", "transitions", "pairs", "upper", "lower", "digit", "other", "distinct", "hex", "coverage", "longest_word", "prefix", "for", "against", "assigned", "quoted", "slashes", "url", "plain_path", "secret_path", "uuid", "repeats", "wordlike_sides")


@dataclass
class Language:
    """What the corpus says of its words: the most frequent ones, and for each two letters the bits that the second costs after the first (26 x 26, row by row)."""

    words: list[str]
    pairs: list[float]


def dictionary(words: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(word): the most frequent of words(word, n) with four letters or more, of equally frequent ones the first in order."""
    return words.where(F.length("word").between(SHORTEST, LONGEST)).orderBy(F.desc("n"), "word").limit(size).select("word")


def language(docs: DataFrame) -> Language:
    """Counted over all rows; what reaches the driver are DICTIONARY words and 676 counts."""
    words = common.documents(docs).select(F.explode(F.split(F.lower("text"), r"[^a-z]++")).alias("word")).where("word <> ''")
    words = common.stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    known = [r["word"] for r in dictionary(words).collect()]
    pair = words.where(F.length("word").between(2, LONGEST)).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    n = np.ones((26, 26))
    for r in pair.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        n[ord(r["pair"][0]) - 97, ord(r["pair"][1]) - 97] += r["n"]
    return Language(known, (-np.log2(n / n.sum(1, keepdims=True))).ravel().round(3).tolist())


def features(kind: Column, m: Column, before: Column, after: Column, path: Column, known: Language) -> Column:
    """array<double> in the order of FEATURES."""
    n = F.greatest(F.length(m), F.lit(1))
    runs = F.regexp_extract_all(F.lower(m), F.lit("[a-z]{2,}"), F.lit(0))
    by_length = {k: [w for w in known.words if len(w) == k] for k in range(LONGEST, SHORTEST - 1, -1)}
    costs = F.array(*[F.lit(x) for x in known.pairs])

    def covered(run: Column) -> Column:
        """Letters of the run that words of the dictionary cover, the longest first at each place from the left."""
        state = F.struct(F.lit(1).alias("free"), F.lit(0).alias("sum"))

        def step(acc: Column, i: Column) -> Column:
            longest = F.coalesce(*[F.when((F.length(run) - i + 1 >= k) & F.substring(run, i, F.lit(k)).isin(words), F.lit(k)) for k, words in by_length.items() if words], F.lit(0))
            here = F.when(i >= acc["free"], longest).otherwise(0)
            return F.struct(F.greatest(acc["free"], i + here).alias("free"), (acc["sum"] + here).alias("sum"))

        last = F.length(run) - SHORTEST + 1
        return F.when(last < 1, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), state, step, lambda acc: acc["sum"]))

    def cost(run: Column) -> Column:
        letter = lambda i: F.ascii(F.substring(run, i, F.lit(1))) - 97
        return F.aggregate(F.sequence(F.lit(1), F.length(run) - 1), F.lit(0.0), lambda a, i: a + costs[letter(i) * 26 + letter(i + 1)])

    total = lambda of: F.aggregate(F.transform(runs, of), F.lit(0.0), lambda a, x: a + x)
    steps = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(shape, r"(.)\1*", "x")) - 1
    count = lambda p: F.regexp_count(m, F.lit(p))
    test = lambda c, p: F.rlike(c, F.lit(p))
    values = {
        "kind": F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), kind), "length": F.length(m), "transitions": changes / n, "pairs": F.when(steps > 0, total(cost) / steps).otherwise(0.0), "upper": count("[A-Z]") / n, "lower": count("[a-z]") / n, "digit": count("[0-9]") / n, "other": count("[^A-Za-z0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split(m, ""))) / F.least(n, F.lit(32)), "hex": test(m, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": total(covered) / n, "longest_word": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)) / n,
        "prefix": test(m, r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk[_-]|pk_|eyJ|AIza|glpat-|npm_)"), "for": test(F.right(before, F.lit(24)), FOR), "against": test(F.concat(before, F.lit(" "), F.substring(after, 1, 12)), AGAINST),
        "assigned": test(before, r"[=:]\s*[\"'`]?$"), "quoted": test(before, r"[\"'`]$"), "slashes": count("/"), "url": test(before, r"(?i)(?:https?:|www\.|[a-z]/)[^ ]*$"),
        "plain_path": test(path, PLAIN_PATH), "secret_path": test(path, SECRET_PATH), "uuid": test(m, r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"),
        "repeats": test(m, r"(.)\1{5}"), "wordlike_sides": test(before, r"[A-Za-z,.] $") & test(after, r"^[,.]? [A-Za-z]"),
    }
    return F.array(*[F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def made_findings(words: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(before, match, after, path, label) findings from a fixed seed: secrets as they are assigned, and look-alikes."""
    rng = random.Random(seed)
    pick = rng.choice
    chars = lambda k, s: "".join(pick(s) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = words or ["this", "that", "with", "from", "there", "other"]
    word = lambda: pick(known)
    plain_paths, secret_paths, any_paths = ["tests/test_api.py", "docs/readme.md", "package.lock", "vendor/a.js"], ["config/settings.py", "deploy/.env", "app/credentials.yml"], ["src/main.py", "lib/util.go", "", "web/page"]

    def secret() -> tuple[str, str, str, str]:
        name = pick(["token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret"])
        body = pick([lambda: chars(40, hexa), lambda: chars(32, hexa), lambda: chars(pick([20, 24, 32, 40]), alnum), lambda: "AKIA" + chars(16, alnum[:26] + "0123456789"), lambda: "ghp_" + chars(36, alnum), lambda: chars(43, alnum + "+/") + "="])()
        if rng.random() < 0.2:
            own = pick([lambda: chars(rng.randint(8, 15), alnum + "!@#$%&*?"), lambda: f"{word().title()}{rng.randrange(10000)}{pick('!@#$')}{chars(4, alnum)}"])()
            return f"{pick(['password', 'passwd', 'pwd', 'db_password', 'secret'])}{pick(['=', ': ', ' = '])}", own, f"\n{word()}", pick(secret_paths + any_paths)
        if rng.random() < 0.05:
            return f"{word()}\n", f"-----BEGIN {pick(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{chars(200, alnum + '+/')}\n-----END PRIVATE KEY-----", f"\n{word()}", pick(secret_paths + any_paths)
        lead, tail = pick([(f"{word()} {name} = \"", "\" "), (f"{name}: ", "\n"), (f"{word()} {name}='", "'"), (f"export {name.upper()}=", "\n"), (f"Authorization: Bearer ", "\n")])
        return lead, body, tail + word(), pick(secret_paths + any_paths + any_paths)

    def other() -> tuple[str, str, str, str]:
        k = rng.randrange(11)
        path = pick(plain_paths + any_paths + any_paths)
        if k == 0:
            return f"{word()} {word()} ", "".join(word() for _ in range(rng.randint(4, 6))), f" {word()}", path
        if k == 1:
            return f"{pick(['commit', 'sha1', 'checksum', 'revision', 'etag', 'md5', 'hash'])}{pick([' ', ': ', '='])}", chars(pick([32, 40, 64]), hexa), f" {word()}", path
        if k == 2:
            return f"{pick(['id', 'uuid', 'trace'])}: ", "-".join(chars(j, hexa) for j in (8, 4, 4, 4, 12)), "\n", path
        if k == 3:
            return f"{word()} = ", f"{word()}/{word()}/{word()}-{word()}.{pick(['py', 'html', 'md'])}", f" {word()}", path
        if k == 4:
            return f"https://{word()}.example.com/", f"{word()}/{word()}/{word()}_{rng.randrange(10**6)}", " ", path
        if k == 5:
            return f"{pick(['token', 'password', 'api_key'])} = \"", pick(["x" * 20, "your-token-goes-here", "changeme-changeme1", "example_secret_value", "0" * 32, "<token>".strip("<>") * 4]), "\"", pick(plain_paths + any_paths)
        if k == 6:
            return f"{word()} ", chars(pick([40, 32]), hexa).upper() if rng.random() < 0.5 else chars(rng.randint(16, 30), "0123456789"), f" {word()}", path
        if k == 7:
            return f"{word()}\n", pick("-=_.") * rng.randint(16, 60), f"\n{word()}", path
        if k == 8:
            return f"{pick(['password', 'token', 'secret', 'pwd'])}{pick([': ', '=', ' = '])}{pick(['', chr(34)])}", pick([word(), f"{word()}{word()}", "required", "changeme", "<your-password>", "${PASSWORD}", "********", "None", f"get_{word()}()"]), f" {word()}", path
        if k == 9:
            return f"{word()} ", "_".join(word().upper() for _ in range(4)), f"={word()}", path
        return f"{word()}: ", f"{word()}_{word()}_{word()}_{word()}_{rng.randrange(100)}", f" {word()}", path

    return [(*(secret() if i % 2 else other()), i % 2) for i in range(n)]


FINDINGS = "before string, match string, after string, path string, label int"


def _beside(own: Column):
    """A function of spans found: these, and of own what overlaps none of them."""

    def both(found: Column) -> Column:
        places = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.concat(found, spans.let(spans.bounded(places), lambda taken: F.filter(own, lambda c: ~spans.overlapping(taken, c))))

    return both


def candidates(text: Column) -> Column:
    """array<SPAN> of all patterns, by their order; what overlaps a span of an earlier pattern isn't one of a later."""
    every = None
    for kind, (pattern, needs) in reversed(PATTERNS.items()):
        own = F.when(F.rlike(text, F.lit(needs)), spans.find(text, kind, pattern)).otherwise(spans.none())
        every = own if every is None else spans.let(every, _beside(own))
    return F.array_sort(F.transform(every, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["m"].alias("m"))))


def described(rows: DataFrame, known: Language) -> DataFrame:
    """rows(text, path) with `described`: an array of start, end and features f of every candidate."""
    text = F.col("text")

    def of(c: Column) -> Column:
        before, after = spans.around(text, c, CONTEXT)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), features(c["kind"], c["m"], before, after, F.col("path"), known).alias("f"))

    return rows.withColumn("described", F.transform(candidates(text), of))


def fit(findings: DataFrame, known: Language) -> trees.Forest:
    """The forest of labelled findings (FINDINGS), of which at most trees.MOST_ROWS by hash are used: of the candidates that the patterns find in them, those that overlap a match have its label, others are none."""
    rows = findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "match", "after", "path")], "label").withColumn("h", F.xxhash64("before", "match", "after", "path", "label"))
    rows = rows.orderBy("h").limit(trees.MOST_ROWS).withColumn("text", F.concat("before", "match", "after"))
    begin, end = F.length("before"), F.length("before") + F.length("match")
    found = described(rows, known).select("label", "h", begin.alias("begin"), end.alias("end"), F.explode("described").alias("c"))
    own = (F.col("c.start") < F.col("end")) & (F.col("begin") < F.col("c.end"))
    rows = found.select(F.when(own, F.col("label")).otherwise(0).alias("label"), F.col("c.f").alias("f"), "h", F.col("c.start").alias("at")).orderBy("h", "at").collect()
    return trees.random_forest(np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows]))


def scan(docs: DataFrame, forest: trees.Forest, known: Language, path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, candidates): every candidate of every row with start, end, score and verdict, in order."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = described(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), path.alias("path")), known)
    scored = F.expr(f"transform(described, c -> named_struct('start', c.start, 'end', c.end, 'score', {forest.sql('c.f')}))")
    return rows.select("doc_id", scored.alias("scored")).select("doc_id", F.transform("scored", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score"), (c["score"] >= threshold).alias("secret"))).alias("candidates"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end of each secret, comma-joined)."""
    secret = F.filter("candidates", lambda c: c["secret"])
    return found.select("doc_id", F.size("candidates").cast("bigint").alias("n_candidates"), F.size(secret).cast("bigint").alias("n_secrets"),
                        F.array_join(F.transform(secret, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",").alias("spans"))


def default_forest(docs: DataFrame) -> tuple[trees.Forest, Language]:
    """The forest of made findings, with what the corpus says of its words."""
    known = language(docs)
    return fit(docs.sparkSession.createDataFrame(made_findings(known.words), FINDINGS), known), known


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return report(scan(docs, *default_forest(docs)))
