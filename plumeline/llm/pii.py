"""Personal data: candidate spans, scored by boosted trees, in SQL functions only.

Generators of high recall propose spans, overlapping ones too, each from a pattern that
runs in time linear in the text. A span whose format proves itself (an address, a
number with the right check digit) is kept. All others are scored by gradient-boosted
trees on features of their format (check digits, forms of numbers that are given out,
digits that repeat) and of the text on both sides, and kept beyond a threshold that is
calibrated on held-out examples for each kind. Of overlapping spans base ones stay, then
the one of the highest score. The trees are trained in numpy from EXAMPLES sentences:
a form of number, and a wording that speaks for it, against it or for nothing. Most
wordings have no word of the features' lists, so the trees learn from persons, names,
codes, punctuation and the number's own form too; and then are a column expression.

Positions come from the gaps between matches: `split` and `regexp_extract_all` see
the same leftmost matches, so a match starts where the gaps and matches before it end.

Nulls and edge cases: a null or empty text has no spans; a null doc_id and repeated
rows are kept as they are; an empty table gives no rows; texts are searched whole.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

#: Labelled examples made for training; a fifth of them is held out to calibrate the thresholds.
EXAMPLES = 6000
TREES, DEPTH, RATE = 60, 3, 0.2
#: Of the kept held-out candidates of a kind, so many must be right.
PRECISION = 0.97
BASE = ("email", "ip", "card", "phone")

_L = "A-Za-z0-9._%+-"
#: Between digits, a space is written \x01 and a hyphen \x02, so that a number with separators is a run of one class.
SPACED, HYPHENED = "\x01", "\x02"
#: Kinds in their order, and their patterns.
PATTERNS: dict[str, str] = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{SPACED}{HYPHENED}])[0-9](?:[{SPACED}{HYPHENED}]?[0-9]){{11,18}}(?![0-9{SPACED}{HYPHENED}])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)

#: Words near a span that speak for and against personal data.
CUES = {
    "phone": "phone|tel|telephone|call|calls|mobile|cell|fax|dial|ring|text|sms|reach|contact|telefon|handy|anrufen|appeler|portable|teléfono|móvil|llamar",
    "identity": "ssn|social|security|identity|passport|tax|citizen|ausweis|identité|passeport|pasaporte|dni",
    "bank": "iban|account|bank|transfer|wire|pay|konto|überweisen|compte|virement|cuenta|banco",
    "other": "order|invoice|version|isbn|part|ref|reference|hash|build|serial|ticket|model|item|sku|tracking|case|lot|code|bestellung|rechnung|commande|facture|pedido|factura",
}
PERSONS = "i|he|she|we|you|they|him|them|who|me|us|mr|mrs|ms|dr|his|her|your|our|my|their|ich|er|sie|wir|il|elle|nous|vous|él|ella|usted"
#: Code points before and after a span that count as near it.
BEFORE, AFTER = 40, 24
FEATURES = (*KINDS[4:], "digits", "distinct", "symbols", "ends_in_zeros", "given_out", "checked", "brackets", *(f"{c}_before" for c in CUES), *(f"{c}_after" for c in CUES), "own", "glued", "digits_near", "copula", "dashes", "dots", "person_before", "person_after", "name_before", "code_before", "colon", "words_before", "longest_before", "money", "letter_joined")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(values, value), F.lit(0), lambda n, d: n + d) % 10 == 0


def proves_itself(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255")  # noqa: E731  equally long strings of digits
        return F.forall(F.split(text, r"\."), lambda p: small(F.ltrim(p, F.lit("0"))))
    if kind == "card":
        return luhn(digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(False)


def found(kind: str, text: Column, marked: Column) -> Column:
    """All leftmost matches of a kind as (kind, start, end, text), in code points."""
    source = marked if kind == "card" else text
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<kind: string, start: int, end: int, text: string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(now: Column, pair: Column) -> Column:
        start = now["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("text"))
        return F.struct(end.alias("at"), F.concat(now["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.split(source, pattern, -1), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.when(F.regexp_like(source, F.lit(pattern)), F.aggregate(pairs, zero, step, lambda end: end["spans"])).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans of all kinds, in the order of kinds."""
    text = F.coalesce("text", F.lit(""))
    marked = F.translate(text, SPACED + HYPHENED, "\x03\x03")
    marked = F.regexp_replace(F.regexp_replace(marked, "(?<=[0-9]) (?=[0-9])", SPACED), "(?<=[0-9])-(?=[0-9])", HYPHENED)
    rows = docs.select("doc_id", text.alias("text"), F.when(F.regexp_like(text, F.lit("[0-9][ -][0-9]")), marked).otherwise(F.translate(text, SPACED + HYPHENED, "\x03\x03")).alias("marked"))
    return rows.select("doc_id", "text", F.concat(*[found(k, F.col("text"), F.col("marked")) for k in KINDS]).alias("spans"))


def mod97(text: Column) -> Column:
    """What an account number leaves, its first four places last and letters as numbers from 10 on."""
    turned = F.upper(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4)))
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    step = lambda n, v: (n * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), step)


def features(span: Column, text: Column) -> dict[str, Column]:
    cased = F.substring(text, F.greatest(span["start"] - BEFORE, F.lit(0)) + 1, F.least(span["start"], F.lit(BEFORE)))
    before = F.lower(cased)
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(AFTER)))
    number = digits(span["text"])
    phone, identity, bank = (span["kind"] == k for k in ("local_phone", "national_id", "iban"))
    near = lambda where, words: F.regexp_like(where, F.lit(rf"(?<!\pL)(?:{words})(?!\pL)"))
    is_ = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {k: is_(span["kind"] == k) for k in KINDS[4:]}
    out["digits"] = F.length(number)
    out["distinct"] = F.size(F.array_distinct(F.split(number, "")))
    out["symbols"] = F.length(span["text"]) - F.length(number)
    out["ends_in_zeros"] = is_(number.rlike("00+$"))
    out["given_out"] = is_(phone & number.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") | identity & number.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))
    out["checked"] = is_(F.when(bank, mod97(F.replace(span["text"], F.lit(" "), F.lit(""))) == 1))
    out["brackets"] = is_(span["text"].startswith("("))
    out |= {f"{c}_before": is_(near(before, words)) for c, words in CUES.items()}
    out |= {f"{c}_after": is_(near(after, words)) for c, words in CUES.items()}
    out["own"] = is_(near(before, "my|me|us|our|his|her|your|mein|meine|mich|mon|ma|mi"))
    out["glued"] = is_(before.rlike("[^ ]$"))
    out["digits_near"] = F.length(digits(before)) + F.length(digits(after))
    out["copula"] = is_(before.rlike("(?: at| is| on| to|:|=) ?$"))
    out["dashes"] = F.length(F.regexp_replace(span["text"], "[^-]", ""))
    out["dots"] = F.length(F.regexp_replace(span["text"], "[^.]", ""))
    out["person_before"], out["person_after"] = is_(near(before, PERSONS)), is_(near(after, PERSONS))
    # a word with a capital that doesn't begin its sentence, and a sign of a code: two capitals or more, a number sign, "no."
    out["name_before"] = is_(cased.rlike(r"(?:\p{Ll},? |\p{Lu}\p{Ll}+ |\. )\p{Lu}\p{Ll}+[^.!?]{0,12}$"))
    out["code_before"] = is_(cased.rlike(r"(?:(?<!\pL)\p{Lu}{2,}|#|(?<!\pL)[Nn](?:o|r|um)\.)[^\pL]{0,3}$"))
    out["colon"] = is_(before.rlike("[:=] ?$"))
    words = F.filter(F.split(before, r"[^\pL]+"), lambda w: F.length(w) > 0)
    out["words_before"] = F.size(words)
    out["longest_before"] = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
    out["money"] = is_(before.rlike("[$€£¥] ?$") | after.rlike("^ ?(?:[$€£¥%]|usd|eur)"))
    out["letter_joined"] = is_(before.rlike(r"[\pL_/-]$"))
    return {k: out[k] for k in FEATURES}


#: What examples are made of; {} is the number. Wordings that speak for a kind, wordings against all, and for
#: nothing. A third of them at most has a word of CUES: what decides is who does what, the form of the number, and its neighbours.
SPEAKING = {
    "national_id": [
        "my social security number is {}", "SSN {}", "{} is on her passport", "tax id {} for the return", "the applicant has {}, born in May", "she was issued {} in Ohio", "his card shows {}",
        "the file of Maria Lopez gives {}", "John Reed, {}", "born 1970, {}", "we have {} for the patient", "he wrote {} on the form", "the widow filed under {}", "{} belongs to the tenant",
        "their records have {} for him", "the nurse typed {} for Mr. Hall", "a person with {}", "the new hire gave {}", "for Anna Smith the clerk found {}", "enrolled as {}", "the claimant, {}, died",
    ],
    "local_phone": [
        "call me at {}", "telephone number {}", "Tel. {}", "mobile: {}", "text us on {}", "contact {} to book", "Telefon {}", "fax {} or write", "you can get her on {}", "try {} after six",
        "Dr. Brown, {}", "ask for Tom, {}", "John Miller {}", "leave word for him at {}", "she answers {} in the morning", "we are open, {}", "Emma ({})", "his new one is {}", "signal {}", "the desk: {}",
        "write to us or try {}", "speak with Mr. Hall, {}", "they live on Main Street, {}", "for questions {}", "{} (ask for Peter)", "{} after lunch, please", "my sister picks up {}", "hotline {}", "evenings: {}",
        "they gave me {}", "her husband has {}", "viber {}", "the plumber, {}, came", "she moved, now {}", "Lucy Gray at {}", "home {}", "work {}", "the clinic says {}", "use {} for emergencies", "mein Bruder hat {}",
    ],
    "iban": ["please wire it to {}", "{} is our IBAN", "Konto {}", "the rent goes to {}", "and {}", "send it here: {}", "mine is {}", "she uses {}", "{} for the deposit", "payable to Anna Smith, {}"],
}
AGAINST = [
    "order {}", "invoice no. {}", "part number {}", "version {}", "ticket {} was closed", "{} is the model", "call the desk about order {}", "ref. {}", "Rechnung {}", "lot {} was recalled",
    "PO {}", "RMA {}", "the pump, {}, is out of stock", "catalogue {}", "parcel {} left the depot", "standard {} applies", "record {} of the database", "MAC {} of the card", "PN {}", "row {} of the sheet",
    "firmware {}", "chip {}", "they shipped {} on Monday", "we returned {} to the shop", "the bolt {} fits", "batch {} expired", "under patent {}", "docket {}", "#{}", "no. {}", "ID {}", "your parcel {} is late", "he bought {} cheaply",
    "the router {} rebooted", "schema {}", "receipt {}", "bill {} is due", "policy {}", "grid {}", "pages {}", "he broke {} in two", "{} pieces", "{} units were sold", "{} EUR", "$ {}", "coordinates {}", "scores {}", "ratio {}",
]
NEUTRAL = ["the {} and", "it was {} then", "{}", "in {} they", "with {} of", "a {} on", "le {} de", "der {} und", "1 20 {} 44", "{}, 17, 230, 5"]


def examples(spark: SparkSession, n: int = EXAMPLES, seed: int = 1) -> DataFrame:
    """doc_id, text, kind and label of sentences with one number each: personal (1) if it is of the kind's form, given out, and nothing speaks against it."""
    rng = np.random.default_rng(seed)
    draw = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda values: values[rng.integers(len(values))]

    def account(right: bool) -> str:
        country = pick(["DE", "FR", "ES", "GB", "NL", "IT"])
        own = draw(pick([12, 14, 18, 20]))
        rest = int("".join(str(int(c, 36)) for c in own + country + "00")) % 97
        check = (98 - rest + (0 if right else int(rng.integers(1, 96)))) % 97
        text = f"{country}{check if check > 1 else check + 97:02d}{own}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.3 else text

    def number(kind: str, right: bool) -> str:
        if kind == "iban":
            return account(right)
        if kind == "national_id":
            return f"{rng.integers(1, 900):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10000):04d}" if right else f"{draw(3)}-{draw(2)}-{draw(4)}"
        first = f"{rng.integers(200, 1000)}", f"{rng.integers(200, 1000)}", draw(4)
        a, b, c = first if right else (draw(3), draw(3), draw(4))
        forms = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}"] if right else ["{}-{}-{}", "{}.{}.{}", "{} {} {}"]
        return pick(forms).format(a, b, c)

    rows = []
    for i in range(n):
        kind, way = pick(KINDS[4:]), rng.random()
        if way < 0.5:
            text, right = pick(SPEAKING[kind]), bool(rng.random() < 0.9 or kind != "iban")
        elif way < 0.8:
            text, right = pick(AGAINST), kind == "iban" and bool(rng.random() < 0.1)
        else:
            text, right = pick(NEUTRAL), kind == "iban" and bool(rng.random() < 0.3)
        made = number(kind, right)
        label = int(right if kind == "iban" else way < 0.5)
        lead, tail = pick(["", "Yes, ", "We met again. ", "As agreed, ", "on the 3rd "]), pick(["", ".", " as before", ", thanks", " and so on"])
        rows.append({"doc_id": i, "text": lead + text.format(made) + tail, "kind": kind, "label": label})
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<doc_id: long, text: string, kind: string, label: int>>")
    return spark.range(1).select(F.inline(table))


class Trees:
    """Boosted regression trees of small depth for a yes or no, on integer features."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self.apply(tree, x)
        return self

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        leaf = RATE * float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0:
            return leaf
        best = (1e-6, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[high].sum() ** 2 / (h[high].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, (f, int(cut), low, high))
        if best[1] is None:
            return leaf
        f, cut, low, high = best[1]
        return f, cut, self.grow(x, g, h, low, depth - 1), self.grow(x, g, h, high, depth - 1)

    def apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self.apply(low, x), self.apply(high, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self.apply(t, x) for t in self.trees)

    def column(self, values: list[Column]) -> Column:
        """The same score as an expression."""

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(values[f] <= cut, of(low)).otherwise(of(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + of(tree)
        return out


def threshold(scores: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on so many of the kept are right; beyond all scores if there is none."""
    if not len(scores):
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & np.append(scores[order][1:] != scores[order][:-1], True))
    return float(scores[order][good[-1]]) if len(good) else float("inf")


_models: dict[int, tuple[Trees, dict[str, float]]] = {}


def model(spark: SparkSession) -> tuple[Trees, dict[str, float]]:
    """Trees and each kind's threshold; the driver gets the features of at most EXAMPLES sentences."""
    if EXAMPLES not in _models:
        made = examples(spark)
        spans = candidates(made).select("doc_id", "text", F.explode(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).alias("s"))
        labelled = spans.join(made.select("doc_id", "kind", "label"), "doc_id").withColumn("label", F.when(F.col("s.kind") == F.col("kind"), F.col("label")).otherwise(0))
        rows = labelled.select("doc_id", F.col("s.kind").alias("kind"), "label", *[c.cast("int").alias(k) for k, c in features(F.col("s"), F.col("text")).items()]).orderBy("doc_id", *FEATURES).collect()
        x, y, kinds = np.array([r[3:] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64), np.array([r[1] for r in rows])
        held = np.array([r[0] % 5 == 0 for r in rows])
        trees = Trees().fit(x[~held], y[~held])
        scores = trees.scores(x)
        _models[EXAMPLES] = trees, {k: threshold(scores[held & (kinds == k)], y[held & (kinds == k)]) for k in KINDS[4:]}
    return _models[EXAMPLES]


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (kind, start, end) that are kept, by start, then kind."""
    trees, least = model(docs.sparkSession)
    rows = candidates(docs)
    whole = F.col("text")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    finite = {k: v for k, v in least.items() if np.isfinite(v)}
    limits = F.create_map(*[x for k, v in (finite or {"": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))])

    def proven(span: Column) -> Column:
        own = F.lit(False)
        for kind in BASE:
            own = F.when(span["kind"] == kind, proves_itself(kind, span["text"])).otherwise(own)
        return own

    crosses = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    fields = ("start", "place", "kind", "end")
    result = f"array<struct<{', '.join(f'{f}: {t}' for f, t in zip(fields, ('int', 'int', 'string', 'int'), strict=True))}>>"
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE) & proven(s)), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.select("doc_id", "text", F.when(F.size("spans") > 0, F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).otherwise(F.filter("spans", lambda s: F.lit(False))).alias("open"), F.when(F.size("spans") > 0, base).otherwise(F.array().cast(result)).alias("base"))
    free = F.filter("open", lambda s: ~F.exists("base", lambda b: crosses(s, b)))
    described = F.transform(free, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), F.struct(*[c.alias(k) for k, c in features(s, whole).items()]).alias("f")))
    rows = rows.withColumn("described", F.when(F.size("open") > 0, described))
    scored = F.transform("described", lambda s: F.struct(*[s[f].alias(f) for f in fields], trees.column([s["f"][k] for k in FEATURES]).alias("score")))
    rows = rows.withColumn("scored", F.filter(scored, lambda s: s["score"] >= F.coalesce(limits[s["kind"]], F.lit(float("inf")))))
    better = lambda a, b: (a["score"] > b["score"]) | (a["score"] == b["score"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["place"] < b["place"]))
    # a span goes if a better one crosses it; what only crosses spans that go stays
    ranked = F.array_sort("scored", lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1).otherwise(0))
    empty = F.array().cast(result)
    plain = lambda s: F.array(F.struct(*[s[f].alias(f) for f in fields]))
    chosen = F.aggregate(ranked, empty, lambda kept, s: F.when(F.exists(kept, lambda k: crosses(s, k)), kept).otherwise(F.concat(kept, plain(s))))
    return rows.select("doc_id", "text", F.array_sort(F.concat("base", F.coalesce(chosen, empty))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with every kept span replaced by its kind in brackets; of overlapping spans the first stays."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(now: Column, s: Column) -> Column:
        piece = F.concat(now["out"], F.substring(F.col("text"), now["at"] + 1, s["start"] - now["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= now["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(now["at"], s["end"]).alias("at"), now["out"].alias("out")))

    done = F.aggregate("spans", zero, step)
    return annotate(docs).select("doc_id", done.alias("r"), "text").select("doc_id", F.concat("r.out", F.substring(F.col("text"), F.col("r.at") + 1, F.length("text"))).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    got = annotate(texts(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
