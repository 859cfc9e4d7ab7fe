"""Surrogates in plain Python: one key after another, with none of the library's expressions."""

import hashlib

import regex

from tracklake.llm import pii

FOUND = regex.compile(pii.PATTERN)
FOUND_BEHIND = regex.compile(pii.PATTERN_BEHIND)
HINT_BEHIND = regex.compile(pii.HINT_BEHIND)
KINDS = [("email", pii.EMAIL), ("name", pii.NAME), ("name_behind", pii.NAME_BEHIND), ("mac", pii.MAC), ("ipv6", pii.IPV6), ("ipv4", pii.IPV4), ("iban", pii.IBAN), ("ssn", pii.SSN), ("card", pii.CARD), ("phone", pii.PHONE)]
KINDS = [(k, regex.compile(f"(?:{p})")) for k, p in KINDS]
LATIN = ("", "bcdfghjklmnprstvz", "aeiou", "na", "n")


def find(text):
    """Mentions as (start, stop, mention, type)."""
    pattern = FOUND_BEHIND if HINT_BEHIND.search(text) else FOUND
    out = []
    for m in pattern.finditer(text):
        kind = next((k for k, p in KINDS if p.fullmatch(m[0])), "secret")
        out.append((m.start(), m.end(), m[0], kind))
    return out


def keys(m, kind):
    if kind == "email":
        return [("email", m.lower()), ("domain", m.lower().rsplit("@", 1)[1])]
    if kind == "name":
        title, *words = regex.sub("['’][sS]$", "", m).split(" ")
        female = title.rstrip(".") in f"{pii.FEMALE}|{pii.FEMALE_UNCASED}".split("|")
        return [("given_f" if female else "given_m", w.lower()) for w in words[:-1]] + [("surname", words[-1].lower())]
    if kind == "name_behind":
        tail = next(t for t in pii.BEHIND.split("|") if m.endswith(t))
        body = m[: -len(tail)].rstrip(" ")
        at = len(body) if any("゠" <= c <= "ヿ" for c in body) else 2 if len(body) > 3 else 1
        gender = "f" if tail in pii.FEMALE_BEHIND.split("|") else "m" if tail in pii.MALE_BEHIND.split("|") else "n"
        return [("surname", body[:at])] + ([(f"given_{gender}", body[at:])] if body[at:] else [])
    if kind in ("phone", "card", "ssn"):
        return [(kind, "".join(c for c in m if c in "0123456789"))]
    if kind == "iban":
        return [(kind, m.replace(" ", ""))]
    if kind == "mac":
        return [(kind, m.lower())]
    if kind == "ipv6":
        left, _, right = m.lower().partition("::")
        left, right = [g for g in left.split(":") if g], [g for g in right.split(":") if g]
        return [(kind, ":".join(g.zfill(4) for g in [*left, *["0"] * (8 - len(left) - len(right)), *right]))]
    return [(kind, m)]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def script_of(c):
    return next((s for s in pii.SCRIPTS if regex.search(rf"\p{{{s}}}", c)), None)


def core(kind, key, attempt, secret):
    hexes = "".join(hashlib.sha256("\x1f".join([secret, kind, str(attempt), key, str(i)]).encode()).hexdigest() for i in range(max(4, -(-(3 * len(key) + 4) // 64))))

    def draw(i):
        at = (i - 1) * 3 % (len(hexes) - 4)
        return int(hexes[at : at + 3], 16)

    def shaped(text, fixed=0, hexadecimal=False):
        out = ""
        for i, c in enumerate(text, 1):
            r = draw(i)
            if i <= fixed:
                out += c
            elif c in "0123456789":
                out += str(r % 10)
            elif c.isascii() and c.isalpha():
                letters = "abcdef" if hexadecimal and c.lower() in "abcdef" else pii.LOWER
                x = letters[r % len(letters)]
                out += x if c.islower() else x.upper()
            elif c.isalpha():
                letters = pii.SCRIPTS[script_of(c)][0] if script_of(c) else pii.LOWER
                x = letters[r % len(letters)]
                out += x.upper() if c.isupper() else x
            else:
                out += c
        return out

    def syllables(n, consonants, vowels):
        return "".join(consonants[draw(i) % len(consonants)] + (vowels[draw(i) // len(consonants) % len(vowels)] if vowels else "") for i in range(1, n + 1))

    if kind == "secret" and not any(c.isalnum() for c in key):
        out = "".join(pii.LOWER[draw(i) % 26] for i in range(1, max(8, len(key)) + 1))
        return out + ("".join(str(draw(i + 42) % 10) for i in range(1, max(attempt - pii.WIDER + 1, 1) + 1)) if attempt >= pii.WIDER else "")
    wide, widest = attempt >= pii.WIDER, attempt >= pii.WIDEST
    extra = [draw(i + 42) for i in range(1, max(attempt - pii.WIDER + 1, 1) + 1)]
    letters, figures = ("".join(pii.LOWER[r % 26] for r in extra) if wide else ""), "".join(str(r % 10) for r in extra)
    if kind == "surname" or kind.startswith("given_"):
        _, consonants, vowels, female, male = LATIN if key.isascii() else pii.SCRIPTS.get(next((s for s in pii.SCRIPTS if regex.search(rf"\p{{{s}}}", key)), ""), LATIN)
        one = lambda: syllables(2 + attempt if vowels else len(key) + attempt, consonants, vowels) + {"given_f": female, "given_m": male}.get(kind, "")
        first = one()
        if "-" not in key:
            return first
        hexes = hexes[::-1]
        return f"{first}-{one()}"
    if kind == "ipv4":
        out = ".".join([str(draw(1) % 199 + 11), *(str(draw(i) % 254 + 1) for i in (2, 3, 4))])
    elif kind == "email":
        return shaped(key.split("@")[0]) + letters
    elif kind == "domain":
        body, top = key.rsplit(".", 1)
        return shaped(body) + letters + "." + top
    else:
        fixed = {"phone": 0 if wide else 1, "card": 1, "iban": 2}.get(kind, 0)
        if kind == "secret":
            fixed = len(regex.match("(?:AKIA|gh[pousr]_|sk-)?", key)[0])
        out = shaped(key, fixed, kind in ("mac", "ipv6") or bool(regex.fullmatch("[0-9a-f]+|[0-9A-F]+", key)))
        if kind == "card" and luhn(key) % 10 == 0:
            out = out[:-1] + str(-luhn(out[:-1] + "0") % 10)
    if wide and (kind == "secret" or kind == "phone" and len(key) < 10) or widest:
        out += figures
    return out


def table(found, secret="corpus"):
    """found: (type, key) pairs; a dictionary of them to surrogates."""
    found = set(found)
    attempt = dict.fromkeys(found, 0)
    while True:
        drawn = {k: core(*k, attempt[k], secret) for k in found}
        scope = lambda k: (k[0], k[1].rsplit("@", 1)[1] if k[0] == "email" else "", drawn[k])
        first = {}
        for k in sorted(found, key=lambda k: (attempt[k], k[1].encode())):
            first.setdefault(scope(k), k)
        real = lambda k: (k[0], f"{drawn[k]}@{scope(k)[1]}" if k[0] == "email" else drawn[k])
        bad = [k for k in found if (first[scope(k)] != k or real(k) in found) and (k[0] == "secret" or any(c.isalnum() for c in k[1]))]
        if not bad:
            return drawn
        for k in bad:
            attempt[k] += 1


def shown(m, kind, cores):
    """The surrogate in the mention's own format."""
    cased = (lambda x: x.upper()) if m.upper() == m and m.lower() != m else (lambda x: x)

    def refilled(signs):
        out, at = "", 0
        for c in m:
            if c in signs:
                out, at = out + cores[0][at : at + 1], at + 1
            else:
                out += c
        return out + cores[0][at:]

    if kind == "email":
        return cased("@".join(cores))
    if kind == "name":
        title = m.split(" ")[0]
        name = " ".join("-".join(p[:1].upper() + p[1:].lower() for p in x.split("-")) for x in cores)
        return title + " " + cased(name) + (regex.search("(['’][sS])?$", m)[0])
    if kind == "name_behind":
        return "".join(cores) + regex.search(f" ?(?:{pii.BEHIND})$", m)[0]
    if kind in ("phone", "card", "ssn"):
        return refilled("0123456789")
    if kind == "iban":
        return refilled("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return cased(cores[0]) if kind in ("mac", "ipv6") else cores[0]


def surrogates(texts, secret="corpus"):
    """All texts of a corpus with surrogates; what isn't an entity stays."""
    found = [find(t or "") for t in texts]
    to = table((k for ms in found for _, _, m, kind in ms for k in keys(m, kind)), secret)
    out = []
    for text, ms in zip(texts, found, strict=True):
        new, at = "", 0
        for a, b, m, kind in ms:
            new += text[at:a] + shown(m, kind, [to[k] for k in keys(m, kind)])
            at = b
        out.append(None if text is None else new + text[at:])
    return out
