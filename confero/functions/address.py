"""Street addresses: tokens, parts and set ratios as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lower_plain

# Words of addresses and what they stand for.
STOP_WORDS = ("de", "da", "do", "das", "dos", "e")
STREETS = {
    "avenida": ("av", "avd", "aven", "ave"), "alameda": ("al", "alm"), "rua": ("r",), "rodovia": ("rod",), "estrada": ("estr", "est"),
    "travessa": ("tv", "trav"), "praca": ("pc", "prac"), "largo": ("lgo",), "vila": ("vl",), "jardim": ("jd",), "parque": ("pq", "pqe"),
}
COMPLEMENTS = {
    "apto": ("ap", "apt", "apartamento", "apart"), "bloco": ("bl", "blc", "blocos"), "conjunto": ("cj", "cjto", "conj"), "sala": ("sl",), "casa": ("cs",),
    "andar": (), "quadra": ("qd",), "lote": ("lt",), "fundos": (), "frente": (), "galpao": (), "box": (),
}
NUMBERS = ("n", "no", "num", "nro", "nr")
WITHOUT_NUMBER = ("sn", "s", "semnumero", "sem_numero", "semn")


def tokenize(c: Column) -> Column:
    """Words of an address, digits and letters apart, abbreviations written out, stop words dropped."""
    s = F.regexp_replace(lower_plain(F.coalesce(c, F.lit(""))), r"[#'\"()\[\]{}\-/\\.,;:]", " ")
    s = F.regexp_replace(F.regexp_replace(s, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")

    def full(x: Column) -> Column:
        out = F.when(x.isin(*NUMBERS), "numero").when(x.isin(*WITHOUT_NUMBER), "semnumero")
        for word, short in (STREETS | COMPLEMENTS).items():
            out = out.when(x.isin(*short), word) if short else out
        return out.otherwise(x)

    words = F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")
    return F.filter(F.transform(words, full), lambda x: ~x.isin(*STOP_WORDS))


def parts(t: Column) -> Column:
    """Street, number and complement: all before the first number word, number or marker is the street; the first
    number is the number unless the address says before it that it has none."""
    digits = lambda x: x.rlike("^[0-9]+$")
    bare = lambda x: F.when(digits(x), F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(x)
    first = lambda a, test: F.coalesce(F.array_position(F.transform(a, lambda x: test(x)), True), F.lit(0))

    def cut(at: Column) -> Column:
        return let(F.when(at == 0, F.size(t)).otherwise(at - 1).cast("int"), lambda n: let(F.struct(F.slice(t, F.lit(1), n).alias("via"), F.slice(t, n + 1, F.size(t)).alias("tail")), placed))

    def placed(v: Column) -> Column:
        found = F.struct(first(v["tail"], lambda x: x == "semnumero").alias("none"), first(v["tail"], digits).alias("number"))
        return let(found, lambda f: named(v["via"], v["tail"], f["none"], f["number"]))

    def named(via: Column, tail: Column, none: Column, number: Column) -> Column:
        used = F.when((number > 0) & ((none == 0) | (number < none)), number).otherwise(0)
        numero = F.when(none > 0, "sn").when(number > 0, let(F.try_element_at(tail, number.cast("int")), bare)).otherwise("")
        rest = F.filter(F.transform(tail, lambda x, i: F.when(x.isin("numero", "semnumero") | (i + 1 == used), "").otherwise(bare(x))), lambda x: x != "")
        return let(F.struct(numero.alias("numero"), rest.alias("rest")), lambda z: whole(via, z["numero"], z["rest"]))

    def whole(via: Column, numero: Column, rest: Column) -> Column:
        every = F.concat(via, F.when(numero != "", F.array(numero)).otherwise(F.array().cast("array<string>")), rest)
        return F.struct(F.array_join(via, " ").alias("via"), via.alias("via_tokens"), numero.alias("numero"), F.array_join(rest, " ").alias("complemento"), rest.alias("complemento_tokens"), every.alias("all_tokens"))

    return let(first(t, lambda x: digits(x) | x.isin("numero", "semnumero", *COMPLEMENTS)), cut)


#: Places of the left string that stand in one long: sums of two such words and a carry stay positive.
_PLACES = 62


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, in bit-parallel form.

    For each character of b, the places where a holds it meet a row of bits in one addition; a 0 in the last row is a
    character in common.  The row of a long string is several longs, with a carry from one to the next.
    """
    full = F.lit((1 << _PLACES) - 1)
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def masks(v: Column) -> Column:
        left = F.array_distinct(v["left"])
        of = lambda x, w: F.aggregate(F.slice(v["left"], w * _PLACES + 1, F.lit(_PLACES)), F.struct(F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("bit")), lambda s, y: F.struct(F.when(y == x, s["m"].bitwiseOR(s["bit"])).otherwise(s["m"]).alias("m"), (s["bit"] * 2).alias("bit")))["m"]
        rows = F.transform(left, lambda x: F.transform(v["words"], lambda w: of(x, w)))
        return let(F.struct(left.alias("letters"), rows.alias("masks"), v["right"].alias("right"), v["words"].alias("words")), rolled)

    def rolled(v: Column) -> Column:
        def step(row: Column, y: Column) -> Column:
            at = F.array_position(v["letters"], y).cast("int")
            return F.when(at == 0, row).otherwise(let(F.element_at(v["masks"], at), lambda m: added(row, m)))

        def added(row: Column, m: Column) -> Column:
            def word(s: Column, w: Column) -> Column:
                now = F.element_at(row, w + 1)
                both = now.bitwiseAND(F.element_at(m, w + 1))
                total = now + both + s["carry"]
                return F.struct(F.concat(s["row"], F.array(total.bitwiseAND(full).bitwiseOR(now - both))).alias("row"), F.shiftright(total, _PLACES).alias("carry"))

            return F.aggregate(v["words"], F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).cast("long").alias("carry")), word)["row"]

        ones = F.transform(v["words"], lambda w: full)
        return F.aggregate(F.aggregate(v["right"], ones, step), F.lit(0), lambda n, w: n + (_PLACES - F.bit_count(w)).cast("int"))

    parts_ = F.struct(letters(a).alias("left"), letters(b).alias("right"), F.sequence(F.lit(0), F.floor((F.length(a) - 1) / _PLACES).cast("int")).alias("words"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(let(parts_, masks))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two token sets, 0 to 1, times the share of tokens (with repeats) that both have."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))

    def rated(v: Column) -> Column:
        both, left, right = v["both"], v["left"], v["right"]
        s, l, r = F.length(F.array_join(both, " ")), F.length(left), F.length(right)
        whole_l, whole_r = s + 1 + l, s + 1 + r
        edits = l + r - 2 * common_length(left, right)
        ratios = [100.0 - 100.0 * d / n for d, n in ((edits, whole_l + whole_r), (1 + l, s + whole_l), (1 + r, s + whole_r))]
        ratio = F.when((l == 0) | (r == 0), 100.0).otherwise(F.greatest(*ratios))
        shared = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
        return F.when(F.size(both) == 0, F.lit(0.0)).otherwise(ratio / 100.0 * (shared / F.greatest(F.size(a), F.size(b))))

    sets = [F.array_join(F.array_sort(F.array_except(x, y)), " ").alias(n) for n, x, y in (("left", a, b), ("right", b, a))]
    return let(F.struct(F.array_sort(F.array_intersect(a, b)).alias("both"), *sets), rated)
