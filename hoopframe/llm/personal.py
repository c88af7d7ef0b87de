"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Built-in expressions only, and no shuffle: every text is read on its own. The spans of a pattern
come from two linear passes, the matches and the pieces between them; starts are running sums of
their lengths, so no text is searched again for a match. Groups are possessive and starts inside
a run that has already failed are skipped, so long runs of digits or letters stay linear.

Four kinds always count when their own check holds (the base spans): ``email``, ``ip`` (parts up
to 255), ``card`` (12 to 19 digits, Luhn) and ``phone`` (a plus sign, 9 to 15 digits). Proposals
beyond them need a score of ``ENOUGH``:

* ``card``: a digit group of 12 to 19 digits with a right Luhn sum inside a longer run of digits
  that is no card as a whole (two numbers side by side, or a number after another one),
* ``phone``: ten digits in national form without a plus sign; in parentheses they stand on their
  own, without them a word such as "call" must be near,
* ``iban``: two letters, two check digits and the rest, with a remainder of 1 modulo 97.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: The kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone", "iban")

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

DIGITS = r"[0-9]{12,}+"
NATIONAL = r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"

#: Characters of context looked at on either side, as far as the pattern's next match (included) reaches.
NEAR = 40
#: Words that speak for personal data, and words that speak for a plain number.
FOR = {"card": "card|visa|mastercard|amex|credit|debit|payment|cvv",
       "phone": "phone|tel|call|mobile|cell|fax|dial|whatsapp",
       "iban": "iban|account|bank|transfer|konto|bic"}
AGAINST = "order|invoice|serial|isbn|tracking|version|ref"

#: Scores: a shape alone, a shape that stands on its own, a right checksum, a word nearby; the least that counts.
SHAPE, CLEAR_SHAPE, CHECKSUM, WORD, ENOUGH = 0.4, 0.6, 0.3, 0.2, 0.6


def running(lens: Column) -> Column:
    """Sums of all earlier entries of an array, in two levels: blocks of about its root's size."""
    n = F.size(lens)
    step = F.ceil(F.sqrt(n.cast("double"))).cast("int")

    def sums(part: Column, first: Column) -> Column:
        """Running sums of a short array from ``first``."""
        empty = F.struct(first.alias("now"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, empty, lambda a, x: F.struct((a["now"] + x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")),
                           lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: F.slice(lens, b * step + 1, step))
    firsts = sums(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)), F.lit(0).cast("bigint"))
    return F.flatten(F.transform(blocks, lambda x, b: sums(x, F.get(firsts, b))))


def matches(rows: DataFrame, pattern: str, name: str, may: Column | None = None) -> DataFrame:
    """Adds ``name``: the matches of a pattern, each with value, start, end and the text on either side.

    Code points count, ends are exclusive. A text for which ``may`` is false is not searched.
    """
    text = F.col("text") if may is None else F.when(may, F.col("text")).otherwise("")
    found = rows.withColumn("_value", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("_value") > 0
    found = found.withColumn("_piece", F.when(some, F.split("text", pattern, -1)))
    length = lambda c: F.length(c).cast("bigint")
    found = found.withColumn("_len", F.when(some, F.transform("_value", lambda v, i: length(F.get("_piece", i)) + length(v))))
    found = found.withColumn("_sum", F.when(some, running(F.col("_len"))))

    def span(v: Column, i: Column) -> Column:
        start = F.get("_sum", i) + length(F.get("_piece", i))
        before = F.concat(F.when(i > 0, F.get("_value", i - 1)).otherwise(""), F.get("_piece", i))
        after = F.concat(F.get("_piece", i + 1), F.coalesce(F.get("_value", i + 1), F.lit("")))
        return F.struct(v.alias("value"), start.alias("start"), (start + length(v)).alias("end"),
                        F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    none = F.array().cast("array<struct<value:string,start:bigint,end:bigint,before:string,after:string>>")
    return (found.withColumn(name, F.when(some, F.transform("_value", span)).otherwise(none))
            .drop("_value", "_piece", "_len", "_sum"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits have a right Luhn sum: from the right, every second one counts twice, less 9 if over 9."""
    worth = F.transform(F.split(F.reverse(number), ""),
                        lambda c, i: (c.cast("int") * (i % 2 + 1)) - F.when((i % 2 == 1) & (c > "4"), 9).otherwise(0))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters last and letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.replace(value, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97)
    return rest == 1


def is_card(value: Column) -> Column:
    return bound(digits(value), lambda n: F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False))


def base_checks() -> dict:
    return {"email": lambda v: F.lit(True),
            "ip": lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
            "card": is_card,
            "phone": lambda v: F.length(digits(v)).between(9, 15)}


def holding(items: Column, ok) -> Column:
    return F.filter(items, lambda m: ok(m["value"]))


def moved(score: Column, kind: str, m: Column) -> Column:
    """The score after words nearby; letters of any case."""
    near = F.concat_ws(" ", m["before"], m["after"])
    plus = F.when(near.rlike(rf"(?i)(?:^|[^A-Za-z])(?:{FOR[kind]})(?:[^A-Za-z]|$)"), WORD).otherwise(0.0)
    minus = F.when(near.rlike(rf"(?i)(?:^|[^A-Za-z])(?:{AGAINST})(?:[^A-Za-z]|$)"), WORD).otherwise(0.0)
    return F.round(score + plus - minus, 2)


def alone(m: Column) -> Column:
    """No letter or digit touches the match."""
    return ~m["before"].rlike("[A-Za-z0-9]$") & ~m["after"].rlike("^[A-Za-z0-9]")


def inner_card(m: Column) -> Column:
    """Score of a digit group: it must be part of a longer run that is no card itself."""
    left = F.regexp_extract(m["before"], r"((?:[0-9][\x20-]?)*+)$", 1)
    right = F.regexp_extract(m["after"], r"^((?:[\x20-]?[0-9])*+)", 1)
    joined = (F.length(left) + F.length(right)) > 0
    whole = F.concat(left, m["value"], right)
    ok = alone(m) & joined & is_card(m["value"]) & ~is_card(whole)
    return F.when(ok, moved(F.lit(SHAPE + CHECKSUM), "card", m)).otherwise(0.0)


def national_phone(m: Column) -> Column:
    """Score of a national number that no plus sign leads."""
    led = m["before"].rlike(r"\+[0-9][\x20().0-9-]*$")
    shape = F.when(m["value"].startswith("("), CLEAR_SHAPE).otherwise(SHAPE)
    return F.when(alone(m) & ~led, moved(shape, "phone", m)).otherwise(0.0)


def account(m: Column) -> Column:
    size = F.length(F.replace(m["value"], F.lit(" ")))
    ok = F.when(alone(m) & size.between(15, 34), mod97(m["value"])).otherwise(False)
    return F.when(ok, moved(F.lit(SHAPE + CHECKSUM), "iban", m)).otherwise(0.0)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``spans``: structs of start, kind, end, value, score and base, in order.

    ``spans`` are ordered by start, then by the kind's place in ``KINDS``. Spans of different
    kinds may overlap, those of one kind don't. A null text counts as empty and has none; ids may
    be null or repeat, every row is judged on its own; an empty table gives an empty result. Of
    other columns none is read. Long texts are read whole, in time linear in their length (an
    array of n matches is summed in about n * sqrt(n) small steps).
    """
    rows = id_text(docs, id_col, text_col)
    number = F.col("text").rlike("[0-9]")
    for kind, pattern, may in (("email", EMAIL, F.col("text").contains("@")), ("ip", IP, number & F.col("text").contains(".")),
                               ("card", CARD, number), ("phone", PHONE, F.col("text").contains("+") & number),
                               ("group", DIGITS, F.col("text").rlike("[0-9]{12}")), ("national", NATIONAL, number), ("iban", IBAN, number)):
        rows = matches(rows, pattern, f"_{kind}", may)

    def spans(kind: str, items: Column, base: bool, score=None) -> Column:
        return F.transform(items, lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end"),
            m["value"].alias("value"), (F.lit(1.0) if score is None else score(m)).alias("score"), F.lit(base).alias("base")))

    parts = [spans(kind, holding(F.col(f"_{kind}"), ok), True) for kind, ok in base_checks().items()]
    more = [spans("card", F.col("_group"), False, inner_card), spans("phone", F.col("_national"), False, national_phone),
            spans("iban", F.col("_iban"), False, account)]
    parts += [F.filter(m, lambda s: s["score"] >= ENOUGH) for m in more]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def labels(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans as text."""
    found = find_personal(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(labels(base), 256).alias("base_sha256"), labels(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets.

    Of overlapping spans the earlier one stands and swallows the rest.
    """
    found = find_personal(docs, id_col, text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        kept = F.substr(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        out = F.concat(a["out"], kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(a["out"]).alias("out"))

    whole = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), (a["at"] + 1).cast("int"))))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(whole).alias("text"))
