"""Check-digit rules as folds over the characters of a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digit_at(value: Column, i: Column | int) -> Column:
    """Digit at 1-based position ``i``; NULL when it is not a digit."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.substring(value, i, F.lit(1)).try_cast("int")


def _positions(value: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)))


def luhn(digits: Column) -> Column:
    """Doubled positions (second from the right, and so on) add the digit sum of twice the digit."""
    total = F.aggregate(
        _positions(digits), F.lit(0),
        lambda acc, i: acc + F.coalesce(
            F.when(i % 2 == 0, F.translate(F.substring(digits, -i, F.lit(1)), "0123456789", "0246813579"))
            .otherwise(F.substring(digits, -i, F.lit(1))).try_cast("int"), F.lit(0)),
    )
    return F.coalesce(digits.rlike("^[0-9]+$") & (total % 10 == 0), F.lit(False))


def weighted_sum(value: Column, weights: list[int], alphabet_value=None) -> Column:
    """Sum of position weight x digit value over the first ``len(weights)`` characters."""
    value_at = alphabet_value or digit_at
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + value_at(value, i + 1) * F.lit(w)
    return total


def mod97(text: Column) -> Column:
    """Remainder by 97 of an upper-case alphanumeric string with A=10 … Z=35."""
    def step(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit(ALNUM), F.substring(text, i, F.lit(1))) - 1
        return (F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97).cast("int")

    return F.aggregate(_positions(text), F.lit(0), step)


def iban_checksum_ok(compact: Column) -> Column:
    """``compact`` is the IBAN in upper case without blanks."""
    shape = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    turned = F.concat(compact.substr(F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    return F.coalesce(F.when(shape, mod97(turned) == 1), F.lit(False))


def nhs_ok(digits: Column) -> Column:
    """Ten digits, weights 10 to 2, modulus 11; a check value of 10 is never valid."""
    check = 11 - weighted_sum(digits, list(range(10, 1, -1))) % 11
    check = F.when(check == 11, 0).otherwise(check)
    return F.coalesce(F.when(digits.rlike("^[0-9]{10}$"), (check != 10) & (check == digit_at(digits, 10))), F.lit(False))
