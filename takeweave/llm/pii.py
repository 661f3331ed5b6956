"""Personal data by weak supervision: labelers vote, EM weighs them, and a span classifier is trained on the outcome.

Base spans (email, ip, card, phone) come from one pattern and one rule a kind and always stay. Wider patterns add
candidates: spelled-out addresses, national phone numbers, cards with odd separators, IPv6, secrets (values assigned to the name
of a secret, published key formats, long runs of letters and digits) and international account numbers. Six labelers (strict
pattern, which is silent on what has no base pattern, structure, gazetteer, left context for, context against, free edges) vote
yes, no or nothing on every span.
Votes are counted by pattern, of which there are at most 6 * 3^6; expectation-maximisation over these counts estimates
each labeler's reliability, and its posteriors are the soft labels of a naive Bayes classifier on span features,
which decides on the added candidates. Everything runs in DataFrame operations; the driver sees only reliabilities
and feature weights, whose number is fixed by the patterns and buckets.

The patterns use possessive quantifiers and anchors where these give the same matches, so that long runs of one kind
of character are read once.

Null text is empty and has no spans. Rows with equal or null doc_id are searched one by one. An empty table gives no
rows. Positions are code points, the end exclusive. Spans with the same start stand in the order of the kinds. Added spans may hold
base spans (a number inside a secret), else they overlap none. Columns of the input beside text are carried as they are, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeweave.session import written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban")
EM_ROUNDS = 8
CONTEXT = 24

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # \G: right behind a match the local part may begin inside a run.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Names that secrets are assigned to, and beginnings of published key formats.
SECRET_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|authorization|bearer|credentials?"
SECRET_HEADS = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza|eyJ"
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]|--|  )[0-9]{4}(?:[./_]|--|  )[0-9]{4}(?:[./_]|--|  )[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": rf"(?i:{SECRET_NAMES})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?[^\s\"',;<>]{{6,}}|\b(?:{SECRET_HEADS})[A-Za-z0-9_.-]{{12,}}|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{32,}}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
}
# Words and prefixes the labelers know.
EMAIL_ENDINGS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu|ch|at|ca|au|jp"
COUNTRY_CODES = "1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|30|36|38"
UNROUTED = r"0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
FOR = {
    "email": r"mail|contact|write|address|kontakt|courriel|correo",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": r"card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|contact",
    "secret": rf"(?:{SECRET_NAMES}|signature|login)\W*$",
    "iban": r"iban|account|bank|konto|compte|cuenta|transfer",
}
AGAINST = r"version|\bv\.? ?$|isbn|issn|order|invoice|section|build|release|serial|sku|commit|checksum|sha-?[0-9]|md5|digest|etag|uuid"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """The remainder that a correct international account number leaves as 1."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    value = F.transform(F.split(moved, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)))
    return F.aggregate(value, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def secret_value(m: Column) -> Column:
    """What is assigned, without the name before it."""
    return F.regexp_extract(m, rf"^(?:(?i:{SECRET_NAMES})[\"']?[ \t]*[:=][ \t]*[\"']?)?([^\s\"']+)$", 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", "")) == 1
    if kind == "secret":  # a value with letters and digits, or one of eight or more characters that is assigned to a secret's name
        value = secret_value(m)
        return (F.length(value) >= 8) & ((value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | (value != m))
    return F.lit(True)


def _rule(kind: str):
    return lambda x: _valid(kind, x["m"])


_SPAN = "struct<s:int,k:int,e:int,base:boolean,m:string>"
#: Spans that one fold takes, and code points of the pieces that contexts are read from: a long text costs little more than its length.
FOLD = 128
WINDOW = 4096


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once: what stands in a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _blocks(a: Column) -> Column:
    """The elements of an array in arrays of at most ``FOLD``; none for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / FOLD).cast("int") - 1), lambda b: F.slice(a, b * FOLD + 1, F.lit(FOLD)))


def _before(sums: Column) -> Column:
    """For each number the sum of those before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _places(matches: Column, pieces: Column, k: int, base: bool) -> Column:
    """Spans from the matches of a pattern and the pieces between them, of which there is one at least."""

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("s"), F.lit(k).alias("k"), end.alias("e"), F.lit(base).alias("base"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    fold = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), step)["out"]
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"]))
    zipped = F.zip_with(matches, F.transform(pieces, lambda p: F.length(p)), lambda m, gap: F.struct(gap.alias("gap"), m.alias("m")))
    placed = lambda bs: _let(_before(F.transform(bs, length)), lambda at: F.flatten(F.zip_with(bs, at, fold)))
    return _let(zipped, lambda xs: _let(_blocks(F.filter(xs, lambda x: x["m"].isNotNull())), placed))


def candidates(df: DataFrame) -> DataFrame:
    """``df(_text, ...)`` with ``_base`` and ``_more``: arrays of spans (s, k, e, base, m)."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,base:boolean,m:string>>")
    text = F.col("_text")
    rest = df.columns
    df = df.withColumn("_digit", text.rlike("[0-9]"))
    gates = {
        ("email", True): F.contains(text, F.lit("@")),
        ("ip", True): F.col("_digit") & F.contains(text, F.lit(".")),
        ("card", True): F.col("_digit"),
        ("phone", True): F.col("_digit") & F.contains(text, F.lit("+")),
        ("email", False): F.contains(text, F.lit("[dot]")) | F.contains(text, F.lit("(dot)")) | F.contains(text, F.lit(" dot ")),  # the pattern needs one of them
        ("ip", False): F.col("_digit") & F.contains(text, F.lit(":")),
        ("card", False): F.col("_digit"),
        ("phone", False): F.col("_digit"),
        # Assignments have a colon or an equals sign; the other forms count only with a digit, in a run of fifteen characters or more.
        ("secret", False): F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | (F.col("_digit") & text.rlike("(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{15}")),
        ("iban", False): F.col("_digit") & text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    }
    for (kind, base), gate in gates.items():
        pattern = (PATTERNS if base else WIDER)[kind]
        found = f"_{kind}{int(base)}"
        df = df.withColumn(found, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        spans = _places(F.col(found), F.split(text, pattern, -1), KINDS.index(kind), base)
        # The pieces are cut only where there is a match.
        df = df.withColumn(found, F.when(F.size(found) > 0, spans))
        if (base and kind != "email") or kind in ("card", "secret", "iban"):
            df = df.withColumn(found, F.when(F.col(found).isNotNull(), F.filter(found, _rule(kind))))
        if kind == "secret":
            own = lambda x: F.struct((x["e"] - F.length(secret_value(x["m"]))).alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"), secret_value(x["m"]).alias("m"))
            df = df.withColumn(found, F.when(F.col(found).isNotNull(), F.transform(found, own)))
    both = lambda base: F.concat(*[F.coalesce(F.col(f"_{k}{int(base)}"), none) for k in (BASE_KINDS if base else KINDS)])
    df = df.select(*rest, F.sort_array(both(True)).alias("_base"), both(False).alias("_more"))
    inside = lambda x, y: (x["k"] >= len(BASE_KINDS)) & (y["s"] >= x["s"]) & (y["e"] <= x["e"]) & (y["e"] - y["s"] < x["e"] - x["s"])
    hit = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    # Base spans in blocks with their reach: an added span is compared with those of the blocks it meets.
    reach = lambda ys: F.struct(F.get(ys, F.lit(0))["s"].alias("s"), F.array_max(F.transform(ys, lambda y: y["e"])).alias("e"), ys.alias("ys"))
    clear = lambda bs: lambda x: ~F.exists(bs, lambda b: hit(x, b) & F.exists(b["ys"], lambda y: hit(x, y) & ~inside(x, y)))
    kept = _let(F.transform(_blocks(F.col("_base")), reach), lambda bs: F.filter("_more", clear(bs)))
    return df.withColumn("_more", F.when((F.size("_more") > 0) & (F.size("_base") > 0), F.sort_array(kept)).otherwise(F.sort_array("_more")))


def _by_kind(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for kind, v in values.items():
        out = F.when(F.col("k") == KINDS.index(kind), v).otherwise(out)
    return out


LABELERS = ("strict", "structure", "gazetteer", "context_for", "context_against", "edges")


def voted(spans: DataFrame) -> DataFrame:
    """Spans (k, m, base, left, right, ...) with a vote (1, 0, -1 for none) of each labeler and the classifier's features."""
    m, left, right = F.col("m"), F.lower("left"), F.col("right")
    yes = lambda c: F.when(c, 1).otherwise(0)
    only_yes = lambda c: F.when(c, 1).otherwise(-1)
    digits = F.regexp_replace(m, "[^0-9]", "")
    votes = {
        "strict": only_yes(F.col("base")),
        "structure": _by_kind(
            {
                "email": yes(m.rlike("[A-Za-z]{2,}$")),
                "ip": yes(~m.rlike(r"(^|\.)0[0-9]")),
                "card": yes(digits.rlike("^[2-6]")),
                "phone": F.when(m.rlike(r"\([01]"), 0).when(F.length(digits).between(10, 13), 1).otherwise(-1),
                "secret": F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) >= 16), 1).when(m.rlike("^[A-Za-z]+$"), 0).otherwise(-1),
                "iban": F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), 1).otherwise(0),
            }
        ),
        "gazetteer": _by_kind(
            {
                "email": only_yes(F.lower(m).rlike(rf"(\.|dot\)? ?|dot\]? ?)({EMAIL_ENDINGS})$")),
                "ip": F.when(m.rlike(f"^{UNROUTED}"), 0).otherwise(1),
                "card": yes(digits.rlike(f"^({CARD_PREFIXES})")),
                "phone": F.when(m.startswith("+"), yes(digits.rlike(f"^({COUNTRY_CODES})"))).otherwise(-1),
                "secret": F.when(m.rlike(f"^(?:{SECRET_HEADS})"), 1).when(m.rlike("[A-Za-z]{2,}[-_][A-Za-z]{2,}[-_][A-Za-z]{2,}"), 0).otherwise(-1),
                "iban": yes(m.rlike(f"^(?:{IBAN_COUNTRIES})")),
            }
        ),
        "context_for": _by_kind({kind: only_yes(left.rlike(pattern)) for kind, pattern in FOR.items()}),
        "context_against": F.when(left.rlike(AGAINST), 0).otherwise(-1),
        "edges": yes(~F.col("left").rlike(r"[\p{L}\p{N}]$") & ~right.rlike(r"^[\p{L}\p{N}]")),
    }
    features = {
        "length": F.least(F.floor(F.length("m") / 4), F.lit(10)).cast("string"),
        "digits": F.floor(F.length(digits) * 8 / F.length("m")).cast("string"),
        "marks": F.least(F.length(F.regexp_replace("m", r"[\p{L}\p{N}]", "")), F.lit(8)).cast("string"),
        "head": F.when(m.rlike("^[0-9]"), "9").when(m.rlike(r"^\p{L}"), "a").otherwise(F.substring("m", 1, 1)),
        "near": F.concat(F.when(F.col("left") == "", "0").when(left.rlike(r"\s$"), "s").when(left.rlike(r"[\p{L}\p{N}]$"), "w").otherwise("p"), F.when(right == "", "0").when(right.rlike(r"^\s"), "s").when(right.rlike(r"^[\p{L}\p{N}]"), "w").otherwise("p")),
    }
    return spans.select("*", *[v.cast("int").alias(f"v_{n}") for n, v in votes.items()], *[v.alias(f"f_{n}") for n, v in features.items()])


FEATURES = ("length", "digits", "marks", "head", "near")


def _logit(params: dict) -> Column:
    """Log odds of a span being personal data, given its votes: looked up in one literal map, so the compiled code is the same in each round."""
    odds = {}
    for k, kind in enumerate(KINDS):
        prior, alpha, beta = params[kind]
        odds[f"{k}"] = math.log(prior / (1 - prior))
        for n in LABELERS:
            odds[f"{k}|{n}|1"] = math.log(alpha[n] / beta[n])
            odds[f"{k}|{n}|0"] = math.log((1 - alpha[n]) / (1 - beta[n]))
            odds[f"{k}|{n}|-1"] = 0.0
    table = F.create_map(*[x for key, v in odds.items() for x in (F.lit(key), F.lit(v))])
    total = table[F.col("k").cast("string")]
    for n in LABELERS:
        total = total + table[F.concat_ws("|", F.col("k").cast("string"), F.lit(n), F.col(f"v_{n}").cast("string"))]
    return total


def reliabilities(patterns: DataFrame, rounds: int = EM_ROUNDS) -> dict:
    """kind -> (prior, P(yes | personal data), P(yes | not)) of each labeler, by EM over the vote patterns (k, v_..., n)."""
    params = {k: (0.5, dict.fromkeys(LABELERS, 0.8), dict.fromkeys(LABELERS, 0.2)) for k in KINDS}
    patterns = patterns.coalesce(1)  # at most 6 * 3^6 rows
    for _ in range(rounds):
        weighed = patterns.withColumn("p", 1 / (1 + F.exp(-_logit(params)))).withColumn("yes", F.col("n") * F.col("p")).withColumn("no", F.col("n") * (1 - F.col("p")))
        sums = [F.sum("yes").alias("p"), F.sum("n").alias("n")]
        for n in LABELERS:
            v = F.col(f"v_{n}")
            for share in ("yes", "no"):
                sums += [F.sum(F.when(v == 1, F.col(share)).otherwise(0.0)).alias(f"{n}_{share}_y"), F.sum(F.when(v >= 0, F.col(share)).otherwise(0.0)).alias(f"{n}_{share}_a")]
        rows = {KINDS[r["k"]]: r.asDict() for r in weighed.groupBy("k").agg(*sums).collect()}
        params = {
            k: (
                min(0.99, max(0.01, (r["p"] + 1) / (r["n"] + 2))),
                {n: (r[f"{n}_yes_y"] + 8) / (r[f"{n}_yes_a"] + 10) for n in LABELERS},
                {n: (r[f"{n}_no_y"] + 2) / (r[f"{n}_no_a"] + 10) for n in LABELERS},
            )
            if (r := rows.get(k))
            else params[k]
            for k in KINDS
        }
    return params


def classifier(spans: DataFrame, params: dict) -> Column:
    """Naive Bayes log odds of a span from its features, trained on the posteriors of all voted spans."""
    counted = spans.groupBy("k", *[f"v_{n}" for n in LABELERS], *[f"f_{n}" for n in FEATURES]).agg(F.count("*").alias("n"))
    p = 1 / (1 + F.exp(-_logit(params)))
    rows = counted.select("k", (F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"), F.explode(F.array(*[F.concat_ws("|", F.lit(n), f"f_{n}") for n in FEATURES])).alias("f"))
    model = rows.groupBy("k", "f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # 6 kinds times a fixed number of buckets
    totals = {k: [sum(r[x] for r in model if r["k"] == k) / len(FEATURES) for x in ("yes", "no")] for k in range(len(KINDS))}
    weights = {}
    for r in model:
        yes, no = totals[r["k"]]
        weights[f"{r['k']}|{r['f']}"] = math.log((r["yes"] + 0.5) / (yes + 4)) - math.log((r["no"] + 0.5) / (no + 4))
    table = F.create_map(*[x for key, w in sorted(weights.items()) for x in (F.lit(key), F.lit(w))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    prior = _by_kind({kind: F.lit(math.log((totals[i][0] + 1) / (totals[i][1] + 1))) for i, kind in enumerate(KINDS)})
    score = prior
    for n in FEATURES:
        score = score + F.coalesce(F.try_element_at(table, F.concat_ws("|", F.col("k").cast("string"), F.lit(n), f"f_{n}")), F.lit(0.0))
    return score


def located(docs: DataFrame, columns: list[str], keep_text: bool) -> DataFrame:
    """``_row`` (the named columns), ``_base`` and ``_all`` span arrays (s, k, e), and ``_text`` when asked for."""
    base = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
    found = candidates(base)
    around = lambda a, cs: F.transform(
        a,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["k"].alias("k"),
            x["e"].alias("e"),
            x["base"].alias("base"),
            x["m"].alias("m"),
            near(cs, x["s"] - CONTEXT, x["s"]).alias("left"),
            near(cs, x["e"], x["e"] + CONTEXT).alias("right"),
        ),
    )
    # Places of a string are counted from its start, so contexts are read from overlapping pieces of the text.
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("_text") / WINDOW).cast("int")), lambda b: F.substring(F.col("_text"), b * WINDOW + 1, F.lit(WINDOW + CONTEXT)))

    def near(pieces: Column, begin: Column, end: Column) -> Column:
        begin = F.greatest(begin, F.lit(0))
        b = F.floor(begin / WINDOW).cast("int")
        return F.substring(F.get(pieces, b), begin - b * WINDOW + 1, end - begin)

    found = found.withColumn("_spans", F.concat("_base", "_more"))
    near_spans = F.when(F.size("_spans") > 0, _let(cut, lambda cs: around(F.col("_spans"), cs))).otherwise(around(F.col("_spans"), F.array(F.lit(""))))
    staged = written(
        found.select("_row", *(["_text"] if keep_text else []), F.monotonically_increasing_id().alias("_r"), near_spans.alias("_spans")),
        "spans",
    )
    short = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = staged.where(F.size("_spans") > 0).select("_r", F.explode("_spans").alias("x")).select("_r", "x.*")
    spans = written(voted(rows).drop("left", "right", "m"), "votes")
    patterns = written(spans.groupBy("k", *[f"v_{n}" for n in LABELERS]).agg(F.count("*").cast("double").alias("n")), "patterns")
    params = reliabilities(patterns)
    accepted = spans.where(~F.col("base")).where(classifier(spans, params) > 0)
    more = accepted.groupBy("_r").agg(F.collect_list(F.struct("s", "k", "e")).alias("_extra"))
    base_spans = short(F.filter("_spans", lambda x: x["base"]))
    out = staged.withColumn("_base", F.sort_array(base_spans)).drop("_spans").join(more, "_r", "left")
    everything = F.when(F.col("_extra").isNull(), F.col("_base")).otherwise(F.sort_array(F.concat("_base", "_extra")))
    return out.withColumn("_all", everything).drop("_extra", "_r")


def _joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans beside the base ones) and n_secret of every row."""
    t = located(docs, ["doc_id"], False)
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    added = (F.size("_all") - F.size("_base")).cast("long").alias("n_added")
    secrets = F.size(F.filter("_all", lambda x: x["k"] == KINDS.index("secret"))).cast("long").alias("n_secret")
    return t.select("_row.doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"), added, secrets)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by ``[KIND]``; n_chars, if there, follows the new text.

    Overlapping spans are replaced once, under the kind of the first.
    """
    t = located(docs, docs.columns, True)
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def joined(xs: Column, at: Column) -> Column:
        """The text from ``at`` to the end of a block of spans, read from the whole text once."""

        def step(region: Column):
            def one(acc, x):
                piece = F.concat(F.substring(region, acc["at"] - at + 1, x["s"] - acc["at"]), F.get(tag, x["k"]))
                free = x["s"] >= acc["at"]
                return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

            return one

        zero = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        region = F.substring(F.col("_text"), at + 1, F.array_max(F.transform(xs, lambda x: x["e"])) - at)
        return _let(region, lambda r: F.array_join(F.aggregate(xs, zero, step(r))["out"], ""))

    # A block of spans begins at the greatest end before it.
    ends = lambda bs: F.transform(bs, lambda xs: F.array_max(F.transform(xs, lambda x: x["e"])))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda bs: F.aggregate(ends(bs), zero, lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    text = lambda bs: _let(starts(bs), lambda st: F.concat(F.array_join(F.zip_with(bs, st["out"], joined), ""), F.substring(F.col("_text"), st["at"] + 1, F.length("_text"))))
    done = _let(_blocks(F.col("_all")), text)
    t = t.withColumn("_new", F.when(F.size("_all") > 0, done))
    new = {"text": F.coalesce(F.col("_new"), F.col("_row.text"))}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(kind)).otherwise(F.col("_row.n_chars"))
    return t.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])
