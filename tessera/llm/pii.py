"""Personal data by weak supervision, in column expressions alone.

Spans come from contract patterns (always kept) and from looser ones. Labelers vote on every span: its strict form, a
gazetteer, words before it, a checksum, and what stands right around it. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is and how likely each pattern is to be personal data; with those
posteriors as soft targets a logistic classifier over votes, kind and length is trained and decides on the looser
spans. The driver sees counts of vote patterns only, a bounded number whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, clean_text, table, written
from .spans import clear_of, digits, luhn, matches, shown

#: Contract kinds in their order, then the looser ones.
BASE = ["email", "ip", "card", "phone"]
MORE = ["email_spelt", "iban", "ssn", "phone_local", "name"]
KINDS = BASE + MORE
# A match can't begin inside a run of its first class unless the match before it ended there (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match; cheap to look for.
HINTS = {"email": "@", "phone": "+", "ip": "."}
GIVEN = (
    "Anna Anne Antonio Carlos Carmen Charles Claire David Elena Elizabeth Emma Francisco Hans Heinrich Isabel James "
    "Jean Jennifer John José Juan Julia Karl Klaus Laura Linda Louis Lucía Luis Maria Marie María Mary Michael Michel "
    "Miguel Patricia Paul Peter Pierre Robert Sarah Sofia Susan Thomas William Wolfgang"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme"
DOMAINS = "com org net edu gov info de fr es eu uk us io co"
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE"
LOOSE = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}){1,4}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    r"(?:\b(?:" + TITLES.replace(" ", "|") + r")\.?\x20)?\b\p{Lu}\p{Ll}{1,30}\x20\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?\b",
])
BEFORE = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo", "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell|handy|teléfono",
    "email_spelt": "mail|contact|write|reach|kontakt|courriel|correo", "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax", "phone_local": "phone|tel|call|fax|mobile|cell|handy|teléfono",
    "name": "name|signed|contact|regards|sincerely|gez|firmado",
}
CONTEXT = 32
#: Labelers in the order of their votes: form, list, words before, checksum, what stands around; what is believed at first
#: of the chance that each votes for what is no personal data, and what is. How often a checksum agrees by chance is known,
#: so that isn't estimated.
VOTERS, CHECKSUM = 5, 3
BELIEF = np.array([[0.35, 0.8], [0.35, 0.8], [0.35, 0.8], [0.02, 0.98], [0.35, 0.8]])
ROUNDS = 60


def mod97(account: Column) -> Column:
    """The remainder of an account number that ISO 13616 wants to be 1: the first four characters last, letters as two
    digits."""
    plain = F.regexp_replace(account, "\x20", "")
    letters = F.split(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4)), "")
    digit = lambda c: c.between("0", "9")
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(digit(c), 10).otherwise(100) + F.when(digit(c), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97)
    return F.aggregate(letters, F.lit(0), step)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, 2 against, 0 abstains."""
    v = F.when(yes, 1)
    return (v.when(no, 2) if no is not None else v).otherwise(0)


def _any_word(value: Column, words: str) -> Column:
    return F.regexp_like(value, F.lit(r"(?:^|[^A-Za-z])(?:" + words.replace(" ", "|") + r")(?![A-Za-z])"))


def _votes(kind: str, m: Column) -> Column:
    v, like = m["value"], lambda c, p: F.regexp_like(c, F.lit(p))
    strict = {
        "email": lambda: _vote(like(v, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"), F.lit(True)),
        "ip": lambda: _vote(like(v, r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$") & ~like(v, r"^(?:0|127|255)\."), F.lit(True)),
        "card": lambda: _vote(like(digits(v), r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5)[0-9]+)$"), F.lit(True)),
        "phone": lambda: _vote(like(v, r"^\+[1-9]") & ~like(v, r"[ ().-]{4}"), F.lit(True)),
        "email_spelt": lambda: _vote(like(v, r"[\[(]")), "iban": lambda: _vote(F.char_length(F.regexp_replace(v, "\x20", "")).between(15, 34), F.lit(True)),
        "ssn": lambda: _vote(~like(v, r"^(?:000|666|9)|-00-|0000$"), F.lit(True)),
        "phone_local": lambda: _vote(like(v, r"^\(?[2-9]"), F.lit(True)), "name": lambda: _vote(like(v, r"^(?:" + TITLES.replace(" ", "|") + r")\b")),
    }[kind]()
    listed = {
        "email": lambda: _vote(_any_word(F.regexp_extract(v, r"\.([A-Za-z0-9-]+)$", 1), DOMAINS)),
        "email_spelt": lambda: _vote(_any_word(F.regexp_extract(v, r"([A-Za-z]+)$", 1), DOMAINS), F.lit(True)),
        "iban": lambda: _vote(_any_word(F.substring(v, 1, 2), COUNTRIES), F.lit(True)),
        "name": lambda: _vote(like(v, r"^(?:(?:" + TITLES.replace(" ", "|") + r")\.?\x20)?(?:" + "|".join(GIVEN) + r")\x20")),
    }.get(kind, lambda: F.lit(0))()
    # A card span has passed its check already, so only account numbers can fail theirs.
    checked = {"iban": lambda: _vote(mod97(v) == 1, F.lit(True))}.get(kind, lambda: F.lit(0))()
    near = _vote(like(m["before"], "(?i)" + BEFORE[kind]))
    around = _vote(like(m["before"], r"(?:^|[\s(\[<\"':;,])$") & like(m["after"], r"^(?:$|[\s)\]>\"':;,.!?])"), like(m["before"], r"[A-Za-z0-9_]$|(?i)(?:version|isbn|v\.?|no\.?|rev)\x20?$") | like(m["after"], r"^[A-Za-z0-9_]"))
    code = F.lit(0)
    for x in (strict, listed, near, checked, around):
        code = code * 3 + x
    return code.cast("int")


def _span(kind: str, m: Column) -> Column:
    size = F.least(F.char_length(m["value"]) / 8, F.lit(3)).cast("int")
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["stop"].alias("stop"), _votes(kind, m).alias("votes"), size.alias("size"))


NONE = "array<struct<start:int,kind:int,stop:int,votes:int,size:int>>"


def _valid(kind: str, m: Column) -> Column:
    v = m["value"]
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: F.char_length(F.regexp_replace(x, "^0+", "")).between(0, 3) & (F.substring(F.regexp_replace(x, "^0+", ""), 1, 3).try_cast("int").isNull() | (F.substring(F.regexp_replace(x, "^0+", ""), 1, 3).try_cast("int") <= 255)))
    if kind == "card":
        return F.char_length(digits(v)).between(12, 19) & luhn(digits(v))
    if kind == "phone":
        return F.char_length(digits(v)).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    # A text without a single candidate number or sign isn't split at all.
    pattern = PATTERNS[kind]
    found = F.transform(F.filter(matches(text, pattern, CONTEXT), lambda m: _valid(kind, m)), lambda m: _span(kind, m))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?+[0-9]){11}"))
    return F.when(hint, found).otherwise(F.array().cast(NONE))


def _loose(text: Column) -> Column:
    def kind_of(m: Column) -> Column:
        v, like = m["value"], lambda c, p: F.regexp_like(c, F.lit(p))
        out = F.when(like(v, r"^[0-9]{3}-[0-9]{2}-"), _span("ssn", m)).when(like(v, r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-]"), _span("phone_local", m))
        out = out.when(like(v, r"^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), _span("iban", m)).when(like(v, r"(?:\(at\)|\[at\]|\x20at\x20)"), _span("email_spelt", m))
        return out.otherwise(_span("name", m))

    return F.transform(matches(text, LOOSE, CONTEXT), kind_of)


def _counts(found: DataFrame) -> list[tuple[int, int, int, int]]:
    spans = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes", "s.size").agg(F.count("*").alias("n"))
    return [(r[0], r[1], r[2], r[3]) for r in spans.collect()]  # at most kinds x 3**VOTERS x sizes rows


def estimate(counts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the final classifier, [kind][voter x vote] flattened after one for each kind and size, and each
    labeler's chances of voting for a span, of either class.

    Expectation-maximisation with two classes: a prior for each kind, and for each class and labeler the chance that its
    vote, if it casts one, is for; abstaining says nothing. It starts from the belief that labelers are right more often
    than not, and none is ever taken to be wrong more often than not, so the classes keep their meaning.
    """
    votes = np.array([[(c[1] // 3 ** (VOTERS - 1 - k)) % 3 for k in range(VOTERS)] for c in counts]).reshape(-1, VOTERS)
    kind, n = np.array([c[0] for c in counts], int), np.array([c[3] for c in counts], float)
    prior = np.full(len(KINDS), 0.6)
    says = BELIEF.copy()  # labeler, class: the chance of a vote for
    post = np.full(len(counts), 0.5)
    for _ in range(ROUNDS if len(counts) else 0):
        logs = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])], 1)
        for k in range(VOTERS):
            logs += np.where(votes[:, k, None] == 1, np.log(says[k]), np.where(votes[:, k, None] == 2, np.log(1 - says[k]), 0.0))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        for q in range(len(KINDS)):
            prior[q] = np.clip((3 + (n * post)[kind == q].sum()) / (5 + n[kind == q].sum()), 0.02, 0.98)
        for k in set(range(VOTERS)) - {CHECKSUM}:
            for y, w in enumerate((n * (1 - post), n * post)):
                yes, no = w[votes[:, k] == 1].sum(), w[votes[:, k] == 2].sum()
                says[k, y] = (yes + 50 * BELIEF[k, y]) / (yes + no + 50)
            if says[k, 0] > says[k, 1]:
                says[k] = says[k].mean()
    # The classifier: logistic regression on soft targets.
    x = np.zeros((len(counts), 3 * VOTERS + len(KINDS) + 4))
    for i, c in enumerate(counts):
        x[i, [3 * k + v for k, v in enumerate(votes[i])]] = 1
        x[i, 3 * VOTERS + c[0]] = 1
        x[i, 3 * VOTERS + len(KINDS) + c[2]] = 1
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - post)) + 0.5 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w, says


def _probability(s: Column, w: np.ndarray) -> Column:
    z = F.lit(0.0)
    for k in range(VOTERS):
        vote = (F.floor(s["votes"] / 3 ** (VOTERS - 1 - k)) % 3).cast("int")
        z = z + F.get(F.array(*[F.lit(float(x)) for x in w[3 * k : 3 * k + 3]]), vote)
    z = z + F.get(F.array(*[F.lit(float(x)) for x in w[3 * VOTERS : 3 * VOTERS + len(KINDS)]]), s["kind"])
    z = z + F.get(F.array(*[F.lit(float(x)) for x in w[3 * VOTERS + len(KINDS) :]]), s["size"])
    return 1 / (1 + F.exp(-z))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, kind, stop, votes, size, p) and ``n_base`` of each contract kind.

    For every row of ``docs`` (doc_id, text); positions are code points, ends exclusive; ``kind`` indexes ``KINDS``. A
    null text is empty and has no spans; repeated rows, null ids and an empty table are kept as they are; other columns
    are ignored. Looser spans that overlap a contract span go; the rest stay where the classifier says so.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), clean_text().alias("text"))
    found = rows.select("doc_id", F.concat(*[_base(F.col("text"), k) for k in BASE]).alias("base"), _loose(F.col("text")).alias("more"))
    found = found.withColumn("more", clear_of(F.col("more"), F.col("base")))
    found = written(found, "spans")
    weights, _ = estimate(_counts(found))
    kept = F.filter("more", lambda s: _probability(s, weights) >= 0.5)
    return found.select("doc_id", "base", kept.alias("more"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [of(k) for k in range(len(BASE))]
    return found.select("doc_id", *counts, F.sha2(shown(plain(F.col("base")), KINDS), 256).alias("base_sha256"), shown(plain(F.concat("base", "more")), KINDS).alias("spans"))
