"""Small text columns and the masking rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is searched for, and what takes its place
URI_CREDENTIALS = (r"(mongodb://)[^\s/@:]+(?::[^\s/@]*)?@", r"$1*****:*****@")
URI_PASSWORD = (r"(mongodb://[^\s/@:]+)(?::[^\s/@]*)?@", r"$1:****@")
LOGIN_ARGUMENT = (r"((?:^|\s)-[up]\s+)(?!-)\S+", r"$1****")
PASSWORD_OPTION = (r"(--(?:sslPEMKeyPassword|sslClusterPassword|servicePassword)\s+)\S+", r"$1****")

MASKING_RULES = {
    "uri": URI_CREDENTIALS,
    "login": LOGIN_ARGUMENT,
    "password_option": PASSWORD_OPTION,
}
# keeps the user name, as the per-member form of a URI does
MASKING_RULES_KEEP_USER = {**MASKING_RULES, "uri": URI_PASSWORD}


def as_list(value: Column, is_list: bool) -> Column:
    """A scalar becomes a list of one."""
    return value if is_list else F.array(value)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def gib_to_bytes(gib: Column) -> Column:
    return (gib.cast("double") * F.lit(1024.0 * 1024.0 * 1024.0)).cast("bigint")


def pid_of(text: Column) -> Column:
    """The first line as a number, only if it is all digits."""
    line = F.get(F.split(text, "\n"), F.lit(0))
    return F.when(line.rlike(r"^[0-9]+$"), line.try_cast("bigint"))


def forked_pid(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, r"forked process: ([0-9]+)", 1), F.lit("")).try_cast("bigint")


def version_in(output: Column) -> Column:
    """The last ``vX.Y.Z…`` on the first line of a program's output."""
    line = F.get(F.split(output, "\n"), F.lit(0))
    found = F.regexp_extract_all(line, F.lit(r"v?([0-9]+\.[0-9]+\.[0-9]+[^, ]*)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def mask(text: Column, rules: dict[str, tuple[str, str]]) -> Column:
    for pattern, replacement in rules.values():
        text = F.regexp_replace(text, pattern, replacement)
    return text


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule with a substring found in the text; lower-case substrings ignore case."""
    kind: Column | None = None
    for name, needles in rules:
        hit = F.lit(False)
        for needle in needles:
            subject = F.lower(text) if needle == needle.lower() else text
            hit = hit | subject.contains(needle)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.lit(default) if kind is None else kind.otherwise(default)
