"""Validators of candidate values and small text functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import folded_value


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 digits or more whose Luhn sum is right."""
    return (F.length(digits(value)) >= 13) & F.call_function("luhn_check", digits(value))


def ssn(value: Column) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000."""
    return digits(value).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _weighted(value: Column, weights: list[int]) -> Column:
    d = F.transform(F.split(F.substring(digits(value), 1, len(weights)), ""), lambda x: x.cast("int"))
    d = F.slice(d, 1, len(weights))
    return F.aggregate(F.zip_with(d, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def mod_11_2(value: Column) -> Column:
    """Eighteen places by ISO 7064 MOD 11-2."""
    weights = [2 ** (17 - k) % 11 for k in range(17)]
    check = F.substring(F.lit("10X98765432"), (_weighted(F.substring(value, 1, 17), weights) % 11) + 1, F.lit(1))
    return (F.length(value) == 18) & (F.upper(F.substring(value, 18, 1)) == check)


def my_number(value: Column) -> Column:
    """Twelve digits whose last is the modulus 11 check digit of the others."""
    weights = [k + 1 if k <= 6 else k - 5 for k in range(11, 0, -1)]
    rest = _weighted(value, weights) % 11
    return (F.length(digits(value)) == 12) & (F.substring(digits(value), 12, 1).cast("int") == F.when(rest <= 1, 0).otherwise(11 - rest))


def private_ipv4(value: Column) -> Column:
    """Addresses that no public host has: private, loopback, link-local, shared test and reserved ranges."""
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    a, b, c = o[0], o[1], o[2]
    private = a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 198) & b.isin(18, 19))
    test_nets = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.forall(o, lambda x: x <= 255) & (private | test_nets)


def looks_secret(value: Column) -> Column:
    return (F.length(value) >= 12) | value.rlike(r"[\p{Nd}\p{Lu}]|[^\p{L}\p{N}]")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(value, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))


def high_entropy(value: Column) -> Column:
    """Twenty places or more: hex from 3 bits, other base-64 runs of mixed kinds from 4.5 bits; digits alone never."""
    hexa = value.rlike("^[0-9a-fA-F]+$")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return (F.length(value) >= 20) & ~value.rlike("^[0-9]+$") & F.when(hexa, entropy(value) >= 3.0).otherwise(mixed & (entropy(value) >= 4.5))


def preview(value: Column) -> Column:
    """First character and stars; stars alone for one character."""
    n = F.length(value)
    return F.when(n <= 1, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), n - 1)))


def canonical(value: Column) -> Column:
    """NFKC, trimmed, runs of white space as one space; the identity of a value within its type."""
    return F.trim(F.regexp_replace(folded_value(value), r"\s+", " "))


#: Words that begin no name, in the languages whose names are told by capitals.
NOT_NAMES = "The This That These Those And But Or Of In On At For With From To By As Is Are Was Were It We You They He She Please Thank Thanks Dear Hello Hi Project Team Street Road Avenue Inc Ltd Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()


def latin_name(value: Column) -> Column:
    """Two or more words, none of which is a day, a month or a word that sentences begin with."""
    return ~value.rlike(r"\b(?:" + "|".join(NOT_NAMES) + r")\b")


def no_opener(value: Column) -> Column:
    return ~value.rlike(r"^(?:" + "|".join(NOT_NAMES[:35]) + r")\b")


def no_system_account(value: Column) -> Column:
    return ~value.isin("root", "admin", "shared", "public", "default", "ubuntu", "runner", "guest")


def no_standard(value: Column) -> Column:
    """Not the number of a public standard or report."""
    return ~value.rlike("^(?:ISO|RFC|IEEE|UTF|SHA|IEC|CVE|HTTP)-")


def mixed_kinds(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def han_name(value: Column) -> Column:
    """Han characters that end in no office, place or firm."""
    return ~value.rlike("(?:部|課|社|会|県|市|区|町|村|駅|店|省|局|係|様|年|月|日|中|的|是|了|在|有|和|与|及|公司|集团|大学|学校)$")


VALIDATORS = {"luhn": luhn, "ssn": ssn, "mod_11_2": mod_11_2, "my_number": my_number, "private_ipv4": private_ipv4, "looks_secret": looks_secret, "high_entropy": high_entropy, "latin_name": latin_name, "no_opener": no_opener, "no_system_account": no_system_account, "no_standard": no_standard, "mixed_kinds": mixed_kinds, "han_name": han_name}
