"""The role grammar in plain Python, step by step: what the column expressions are compared with."""

import re

from creditgraph.functions.role_rules import *  # noqa: F403


def parse_roles(text: str | None) -> list[dict]:
    """Roles between commas outside square brackets; each has a name and the details of its brackets."""
    depth, parts, at = 0, [], 0
    text = text or ""
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    parts.append(text[at:])
    return [one_role(p.strip()) for p in parts if p.strip()]


def one_role(text: str) -> dict:
    """The name before the first bracket, and the outermost brackets' contents."""
    name, _, _ = text.partition("[")
    details, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "[":
            depth += 1
            if depth == 1:
                start = i + 1
        elif c == "]":
            depth -= 1
            if depth == 0:
                details.append(text[start:i].strip())
    return {"name": name.strip(), "detail": ", ".join(details) or None}


def apply(rules: list[tuple[str, str]], s: str) -> str:
    for pattern, to in rules:
        s = re.sub(pattern, to, s)
    return s


def string_wording(s: str) -> str:
    """Strings are joined to their number by a hyphen, everywhere in s, unless it names one of the machines."""
    s = apply(STRING_SHORT_FORMS, s)
    if not re.search(STRING_MACHINES, s):
        s = re.sub(*STRING_HYPHEN, s)
    return apply(STRING_ENDINGS, s)


def words_for_numbers(s: str) -> str:
    if "String" in s:
        s = apply([(rf"{n}[- ]String", f"{w}-String") for n, w in STRING_NUMBERS.items()], s)
    s = re.sub(*STRINGS_LAST, s)
    return apply([(rf"{n}[- ]Bit ", f"{w}-Bit ") for n, w in BIT_NUMBERS.items()], s)


def cased(s: str) -> str:
    """Words begin with a capital, unless they are all capitals; so do parts after a hyphen and after an apostrophe that opens
    a word or follows a single d."""
    s = " ".join(w if w.isupper() else w.capitalize() for w in s.split(" "))
    s = re.sub(r"-[a-z]", lambda m: m[0].upper(), s)
    s = re.sub(r"(?:\A| )'[a-zA-Z]", lambda m: m[0].upper(), s)
    s = re.sub(r"(\w)('[a-zA-Z])", lambda m: m[1] + m[2].lower(), s)
    return re.sub(r"( [dD])('[a-zA-Z])", lambda m: m[1].lower() + m[2].upper(), s)


def normalise_role(text: str) -> str:
    if re.fullmatch(CAPITALS, text) and text not in NOT_CAPITALS:
        return text
    s = re.sub(BRACKETS, "", text)
    for small in SMALL_WORDS:
        s = re.sub(rf"(?i)-{small}\b", f" {small}", s)
    number = s.lower().removeprefix("tb-").removeprefix("tr-")
    if s in MACHINES or (number in MACHINES and s.lower() == f"{MACHINES[number].lower()}-{number}"):
        s = f"Roland {MACHINES[number]}-{number}"
    s = cased(s).replace("_", " ")
    for short in SHORT_WORDS:
        s = re.sub(rf"(?i)\b{short}\b", short, s)
    s = apply(FIRST_CLEANUP, s)
    if re.match(NO_NAME, s):
        return ""
    s = words_for_numbers(string_wording(re.sub(*COUNTED, s)))
    if m := re.search(LEADING_NUMBER, s):
        special = NUMBERED_TERMS.get(m[1])
        s = re.sub(*special, s) if special else m[1]
    s = apply(ABBREVIATIONS, apply(NUMBERS_AND_DATES, s))
    if m := re.search(INITIALS, s):
        s = m[1].replace(".", "").upper()
    return apply(ENDINGS, s).strip()


def normalise_roles(text: str | None) -> list[str]:
    """The names in a role text: cut at separators, normalised, cut at full stops, normalised again."""
    s = re.sub(OPEN_BRACKET, "", re.sub(QUOTES, "", re.sub(BRACKETS, "", text or "")))
    once = [normalise_role(p) for p in re.split(SEPARATORS, re.sub(A_AND_R, "ANR", s)) if p]
    parts = [p for o in once for p in o.split(". ")]
    return [n for p in parts if p and (n := normalise_role(p))]
