"""Comparators: two columns to a struct (p array<string>, nota double).

Inputs of names, texts, dates, localities and addresses are normalised; numbers are compared as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.address import parts, token_set_ratio, tokenize
from ..functions.text import flag, let, soundex4, tokens, two_places

ZERO = "0,0"
#: Number of partial scores of each type; T stands for every other type.
SLOTS = {"D": 5, "C": 4, "L": 6, "M": 4, "N": 7, "T": 7}


def _result(points: list[Column], nota: Column) -> Column:
    return F.struct(F.array(*points).alias("p"), nota.cast("double").alias("nota"))


def zeros(n: int) -> Column:
    return _result([F.lit(ZERO)] * n, F.lit(0.0))


def _sum(parts_: list[Column]) -> Column:
    """Left to right, so that the last bit is that of adding one by one."""
    total = F.lit(0.0)
    for p in parts_:
        total = total + p
    return total


def _one(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(0.0)


def _alike(a: Column, b: Column) -> Column:
    """Soundex codes that agree in three of four places."""
    same = [(F.substring(a, i, 1) == F.substring(b, i, 1)).cast("int") for i in range(1, 5)]
    return same[0] + same[1] + same[2] + same[3] >= 3


def _words(l: Column, r: Column, rare: Column | None, common: Column | None, initials: bool, dated: Column | None) -> Column:
    """Each ratio is worked out once, and then both shown and summed."""
    counted = rare is not None and common is not None
    blank = F.lit(False) if dated is None else dated
    tokens_ = F.struct(tokens(l).alias("a"), tokens(r).alias("b"), *([rare.alias("rare"), common.alias("common"), blank.alias("dated")] if counted else []))
    begins = lambda s, t: F.size(F.filter(s, lambda x: (F.length(x) == 1) & F.exists(t, lambda y: F.startswith(y, x))))

    def coded(v: Column) -> Column:
        return let(F.struct(v.alias("v"), F.transform(v["a"], soundex4).alias("x"), F.transform(v["b"], soundex4).alias("y")), measured)

    def measured(c: Column) -> Column:
        v, x, y = c["v"], c["x"], c["y"]
        a, b, n = v["a"], v["b"], F.size(v["a"])
        values = {
            "first": F.get(a, F.lit(0)) == F.get(b, F.lit(0)), "last": F.element_at(a, -1) == F.element_at(b, -1), "equal": F.size(F.filter(a, lambda w: F.array_contains(b, w))) / n,
            "near": F.lit(0.8) * (F.size(F.filter(x, lambda p: F.exists(y, lambda q: _alike(p, q)))) / n), "short": F.lit(0.5) * ((begins(a, b) + begins(b, a)) / n) if initials else F.lit(0.0),
        }
        if counted:
            values |= {"few": v["rare"] / n, "many": -(v["common"] / n), "dated": v["dated"]}
        return F.when((n > 0) & (F.size(b) > 0), let(F.struct(*(c.alias(k) for k, c in values.items())), shown)).otherwise(zeros(7))

    def shown(v: Column) -> Column:
        if counted:
            few, many = (F.when(v["dated"], F.lit(0.0)).otherwise(v[k]) for k in ("few", "many"))
            few_s, many_s = (F.when(v["dated"], ZERO).otherwise(two_places(v[k])) for k in ("few", "many"))
        else:
            few, many, few_s, many_s = F.lit(0.0), F.lit(0.0), F.lit(ZERO), F.lit(ZERO)
        points = [flag(v["first"]), flag(v["last"]), two_places(v["equal"]), few_s, many_s, two_places(v["near"]), two_places(v["short"]) if initials else F.lit(ZERO)]
        return _result(points, _sum([_one(v["first"]), _one(v["last"]), v["equal"], few, many, v["near"], v["short"]]))

    return let(tokens_, coded)


def name(l: Column, r: Column, rare: Column | None = None, common: Column | None = None, initials: bool = True) -> Column:
    """Personal names; without counts the two frequency criteria are 0,0."""
    return _words(l, r, rare, common, initials, None)


def text(l: Column, r: Column, rare: Column, common: Column) -> Column:
    """Free text; values of one token of eight digits on both sides get no frequency criteria."""
    dated = l.rlike("^[0-9]{8}$") & r.rlike("^[0-9]{8}$")
    return _words(l, r, rare, common, True, dated)


def date(l: Column, r: Column) -> Column:
    """Eight digits, year first: equal, one edit, or two edits that reverse day or month or shuffle the year."""
    d = F.levenshtein(l, r)
    both8 = (d == 2) & (F.length(l) == 8) & (F.length(r) == 8)
    piece = lambda c, i, n: F.substring(c, i, n)
    digits = lambda c: F.array_join(F.array_sort(F.split(piece(c, 1, 4), "")), "")
    day = both8 & (F.reverse(piece(l, 7, 2)) == piece(r, 7, 2))
    month = both8 & ~day & (F.reverse(piece(l, 5, 2)) == piece(r, 5, 2))
    year = both8 & ~day & ~month & (F.levenshtein(piece(l, 1, 4), piece(r, 1, 4)) == 2) & (digits(l) == digits(r))
    cases = [l == r, d == 1, day, month, year]
    return _result([flag(c) for c in cases], _one(cases[0] | cases[1] | cases[2] | cases[3] | cases[4]))


def locality(l: Column, r: Column) -> Column:
    """Codes of six characters, state and place: equal, one or two edits, or alike in sound."""
    l, r = F.upper(l), F.upper(r)
    (a, b), (x, y) = ((F.substring(c, 1, 2) for c in (l, r)), (F.substring(c, 3, 4) for c in (l, r)))
    state = F.when(a == b, 0.0).when(F.levenshtein(a, b) == 1, 0.5).when(soundex4(a) == soundex4(b), 0.3).otherwise(0.0)
    d = F.levenshtein(x, y)
    digits = x.rlike("^[0-9]+$") & y.rlike("^[0-9]+$")
    place = F.when(x == y, 0.0).when(d == 1, 0.8).when(d == 2, 0.5).when(~digits & (soundex4(x) == soundex4(y)), 0.4).otherwise(0.0)
    tenth = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    nota = F.lit(0.0) + F.when(a == b, F.lit(1.0)).otherwise(state) + F.when(x == y, F.lit(1.0)).otherwise(place)
    return F.when((F.length(l) == 6) & (F.length(r) == 6), _result([flag(a == b), tenth(state), flag(x == y), tenth(place)], nota)).otherwise(zeros(4))


#: Numbers as written: 27 digits before the mark and 10 after it.
NUMBER = "decimal(37,10)"


def parse_number(c: Column) -> Column:
    """A number as written in either convention; NULL if it is none, or has more than 27 digits before the mark."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    s = F.translate(s, "−\u00a0", "-")
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    body = F.translate(F.regexp_replace(s, "^[+-]", ""), " _'", "")
    last_comma, last_dot = F.length(body) - F.instr(F.reverse(body), ","), F.length(body) - F.instr(F.reverse(body), ".")
    has_comma, has_dot = F.contains(body, F.lit(",")), F.contains(body, F.lit("."))
    body = F.when(has_comma & has_dot, F.when(last_comma > last_dot, F.translate(F.translate(body, ".", ""), ",", ".")).otherwise(F.translate(body, ",", ""))).when(has_comma, F.translate(body, ",", ".")).otherwise(body)
    body = F.regexp_replace(body, r"\.(?=.*\.)", "")
    plain = body.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, F.concat(sign, body).try_cast(NUMBER))


def number(l: Column, r: Column) -> Column:
    """Numbers as written: equal, near in absolute and in relative terms, equal when rounded.

    They are compared and subtracted exactly; only for a quotient are both its sides scaled down to twelve digits
    before the mark."""
    dec = lambda c: c.cast(NUMBER)
    one = F.expr("1BD")

    def near(diff: Column, limit: Column) -> Column:
        """1 - diff / limit, no less than 0."""
        small = lambda c: F.when(limit < F.expr("1e11BD"), c).when(limit < F.expr("1e19BD"), dec(c * F.expr("0.00000001BD"))).otherwise(dec(c * F.expr("0.0000000000000001BD"))).cast("decimal(18,6)")
        return (one - F.least(small(F.least(diff, limit)) / small(limit), one)).cast("double")

    def scored(v: Column) -> Column:
        a, b, diff, scale, whole = (v[x] for x in ("a", "b", "diff", "scale", "whole"))
        tolerance = F.when(whole, dec(F.lit(5))).otherwise(F.greatest(dec(F.expr("0.05BD") * scale), dec(F.expr("0.01BD"))))
        rounded = F.when(whole & (diff <= 1), True).otherwise(F.when(scale <= 1000, F.round(a, 2) == F.round(b, 2)).otherwise(F.round(a, 1) == F.round(b, 1)))
        return let(tolerance, lambda t: let(F.struct((a == b).alias("same"), near(diff, t).alias("n1"), near(diff, scale).alias("n2"), _one(rounded).alias("n3")), shown))

    def shown(v: Column) -> Column:
        return _result([flag(v["same"]), *(two_places(v[x]) for x in ("n1", "n2", "n3"))], _sum([_one(v["same"]), v["n1"], v["n2"], v["n3"]]))

    def measured(v: Column) -> Column:
        a, b = v["a"], v["b"]
        more = F.struct(a.alias("a"), b.alias("b"), dec(F.abs(a - b)).alias("diff"), dec(F.greatest(F.abs(a), F.abs(b), dec(F.lit(1)))).alias("scale"), ((a == F.floor(a)) & (b == F.floor(b))).alias("whole"))
        return F.when(a.isNotNull() & b.isNotNull(), let(more, scored)).otherwise(zeros(4))

    return let(F.struct(parse_number(l).alias("a"), parse_number(r).alias("b")), measured)


def address(l: Column, r: Column) -> Column:
    """Street, number, complement and all tokens of two addresses."""
    cut = lambda t: let(F.struct(parts(t["l"]).alias("l"), parts(t["r"]).alias("r")), lambda s: _address(s["l"], s["r"]))
    return let(F.struct(tokenize(l).alias("l"), tokenize(r).alias("r")), cut)


def _address(a: Column, b: Column) -> Column:
    via = (a["via"] == b["via"]) & (a["via"] != "")
    number_ = (a["numero"] == b["numero"]) & (a["numero"] != "")
    street = F.lit(0.8) * token_set_ratio(a["via_tokens"], b["via_tokens"])
    rest = F.lit(0.5) * token_set_ratio(a["complemento_tokens"], b["complemento_tokens"])
    every = F.lit(0.8) * token_set_ratio(a["all_tokens"], b["all_tokens"])
    jaccard = F.lit(0.5) * jaccard_ratio(a["all_tokens"], b["all_tokens"])
    values = F.struct(*(x.alias(n) for n, x in (("via", via), ("street", street), ("number", number_), ("rest", rest), ("every", every), ("jaccard", jaccard))))

    def shown(v: Column) -> Column:
        points = [flag(v["via"]), two_places(v["street"]), flag(v["number"]), two_places(v["rest"]), two_places(v["every"]), two_places(v["jaccard"])]
        return _result(points, _sum([_one(v["via"]), v["street"], _one(v["number"]), v["rest"], v["every"], v["jaccard"]]))

    return let(values, shown)


def jaccard_ratio(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
