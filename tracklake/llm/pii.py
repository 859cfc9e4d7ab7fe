"""Surrogates for personal data, with DataFrame functions only.

Entities: e-mail addresses, phone and card numbers, social security numbers, IBANs, IPv4, IPv6 and
MAC addresses, secrets (after a word like "password" and = or :, with up to eight blanks around it, to white space or
the quote they began with: eight signs or more, or four with a digit; values that begin with * or = are masks and
comparisons), and names by a form of address: before them (all
capitalised words that follow, or two words of a script without capitals; the last is the surname) or
behind them (Han, Kana and Hangul; the first character or two are the surname). Each is reduced to a key
(digits of a number, lower-case address, each part of a name), so mentions in another format share it. A
key's surrogate is drawn from keyed hashes (SHA-256 of a secret, the type, the key and the attempt):
  numbers     digits for digits; a phone's and a card's first digit stay, a valid card number stays valid
  addresses   an e-mail's domain is drawn from its domain alone, so one domain stays one; octets stay octets
  secrets     letter for letter of the same case, hexadecimal ones stay hexadecimal; the prefix of a kind of key stays;
              one of signs alone becomes letters
  names       syllables of the same script (`SCRIPTS`), given names with an ending of the gender of the form
              of address; given name and surname are keys of their own, so "Mr X" and "Mr A X" agree
A mention is written in its own format: its punctuation and its case; an IPv6 address in full. A letter of a
script that `SCRIPTS` doesn't list becomes a Latin one.

Collision checks over all keys of the corpus: a surrogate that another key has, or that is itself a
key found in the corpus, is drawn again with the next attempt (names get longer; from the fourth on
addresses, secrets and short phone numbers too, and a phone's first digit is drawn; from the thirty-third on
every type gets digits appended, so that no format runs out), until none is left. So distinct entities stay
distinct and equal ones stay equal, in all documents.

Null text stays null. Texts without an entity, also empty ones, stay as they are; a long text is searched
whole. Where two entities could begin at one place, the first of `PATTERN` is taken; of two keys with one
surrogate, the lesser keeps it. Repeated rows get the same text; extra columns, whatever their names, are
kept by surrogates(). An empty table gives no rows. The texts are only read; a row per mention travels, and a
mention that many documents share is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, partitions, written

LOWEST = -(2**63)
#: Documents' surrogates are joined by a broadcast of up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: The attempt from which addresses, secrets and short phone numbers get longer, and that from which all types do.
WIDER, WIDEST = 3, 32

# Forms of address, family names that stand before a Chinese form of address, letters of scripts.
MALE = "Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|Sr|г-н|Κύριος|Κος"
FEMALE = "Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|MADAME|Mme|Señora|Sra|г-жа|Κυρία|Κα"
MALE_UNCASED = "السيد|מר|श्री"
FEMALE_UNCASED = "السيدة|גברת|श्रीमती"
MALE_BEHIND = "先生"
FEMALE_BEHIND = "女士|小姐|太太"
BEHIND = f"{MALE_BEHIND}|{FEMALE_BEHIND}|さん|様|씨|님"
FAMILY = "王李张張刘劉陈陳杨楊黄黃赵趙周吴吳徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾萧蕭田董袁潘于蒋蔣蔡余杜叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔钟鐘谭譚陆陸汪范金石"
#: Script: letters; consonants and vowels of a name's syllables (signs without vowels are syllables themselves); endings of female and male given names.
SCRIPTS = {
    "Cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", "бвгдклмнпрст", "аеиоу", "на", "н"),
    "Greek": ("αβγδεζηθικλμνξοπρστυφχψω", "βγδκλμνπρστ", "αειου", "α", "ς"),
    "Arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "بتجدرسفقكلمن", "اوي", "ة", "د"),
    "Hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", "בגדכלמנפקרשת", "אוי", "ה", "ן"),
    "Devanagari": ("अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "कगचजतदनपबमरलवसह", "ािीुेो", "ना", "न"),
    "Han": ("天地山川日月星林木水火土石玉雪雨云風春夏秋冬东西南北中平安康明光文武", "天山川日月星林木水土石玉雪雨云春夏秋冬东南北中平安康明文", "", "芳", "强"),
    "Hiragana": ("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", "", "", ""),
    "Katakana": ("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ", "", "", ""),
    "Hangul": ("가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후", "", "", ""),
    "Thai": ("กขคงจชซดตทนบปพมยรลวสห", "กขคงจชดตทนบปพมยรลวส", "าี", "", ""),
    "Armenian": ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփք", "բգդկլմնպռստ", "աեիոէ", "ա", "ն"),
    "Georgian": ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "ბგდკლმნპრსტ", "აეიოუ", "ა", "ნ"),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
BLANK = r"\x20\x09-\x0D"


def _value(others: str) -> str:
    """A secret's signs: all but some, eight of them or four with a digit; sentence marks, brackets and quotes at its end aren't its own."""
    c = f"[^{BLANK}{others}]"
    return rf"(?={c}{{8}}|{c}{{0,7}}\d){c}{{4,}}(?<![.?:,;)\]}}>'\"])"


# a value runs to white space or to the quote that it began with, whatever its length; the first lookbehind is the cheap one
SECRET = (
    rf"(?<=[=:'\"{BLANK}])(?<=[=:]['\"]{{0,1}}[{BLANK}]{{0,8}}['\"]{{0,1}})(?<=(?i:token|secret|password|passwd|(?:api|access|secret)[_-]{{0,1}}key)['\"]{{0,1}}[{BLANK}]{{0,8}}[=:][{BLANK}]{{0,8}}['\"]{{0,1}})"
    rf"(?![=*])(?:(?<=\"){_value('\"')}|(?<=')" + _value("'") + r"|(?<!['\"])(?!['\"])" + _value("") + ")"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"
)
# possessive, so that the matcher's stack doesn't grow with the number of words
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{MALE}|{FEMALE})\.?(?: \p{{Lu}}[\p{{L}}\p{{M}}'’-]++)++|(?:{MALE_UNCASED}|{FEMALE_UNCASED})(?: \p{{Lo}}[\p{{L}}\p{{M}}'’-]++){{1,2}}+)"
NAME_BEHIND = (
    rf"[{FAMILY}]\p{{IsHan}}{{0,2}}(?:{MALE_BEHIND}|{FEMALE_BEHIND})|(?<!\p{{IsHan}})\p{{IsHan}}{{2,4}}(?:さん|様)"
    r"|(?<![\p{IsKatakana}ー])[\p{IsKatakana}ー]{2,12}(?:さん|様)|(?<!\p{IsHangul})\p{IsHangul}{3,4} ?(?:씨|님)"
)
MAC = r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"
# a compressed address starts with a group of the global, local or multicast space, which a::b in a program doesn't
IPV6 = (
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![\p{L}\p{N}:_])(?:[23][0-9A-Fa-f]{3}|[Ff](?:[CcDdFf][0-9A-Fa-f]|[Ee][89ABab])[0-9A-Fa-f])(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\p{L}\p{N}:_])"
)
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
PHONE = (
    r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d)(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,6}(?!\d)"
    r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
    r"|(?<![\d.,+-])(?<!\d )(?:[2-9]\d{2} \d{3} \d{4}|0[1-9]\d{0,3}(?: \d{2,4}){2,4})(?! ?\d|[.,-]\d)"
)
# secrets first: a value may hold what looks like another entity
# look-aheads keep most places from trying each of several patterns
PATTERN = "|".join([SECRET, EMAIL, NAME, rf"(?=[0-9A-Fa-f]{{1,4}}[:-])(?:{MAC}|{IPV6})", IBAN, rf"(?=[0-9+(])(?:{IPV4}|{SSN}|{CARD}|{PHONE})"])
#: What a text with a name in front of its form of address has; and what one with another entity has, by what is in ASCII, in any text, in any case.
HINT_BEHIND = rf"\p{{IsHan}}(?:{MALE_BEHIND}|{FEMALE_BEHIND})|[\p{{IsHan}}\p{{IsKatakana}}ー](?:さん|様)|\p{{IsHangul}} ?(?:씨|님)"
ADDRESSED = f"{MALE}|{FEMALE}|{MALE_UNCASED}|{FEMALE_UNCASED}"
HINT = rf"[0-9@]|:(?=[A-Fa-f])(?<=[A-Fa-f]:)|-(?=[A-Fa-f]{{2}}-)(?<=[A-Fa-f]-)|AKIA|gh[pousr]_|sk-|(?=[MHSF])(?<![\p{{L}}\p{{N}}])(?:{ADDRESSED})\.? "
OTHER = [t for t in ADDRESSED.split("|") if not t.isascii() and not "A" <= t[0] <= "Z"]
HINT_OTHER = rf"(?=[{''.join(sorted({t[0] for t in [*OTHER, *BEHIND.split('|')]}))}])(?:(?:{'|'.join(OTHER)})\.? |(?:{BEHIND}))"
HINT_WORDS = "(?=[tTsSpPkK])(?i:token|secret|passw|key)"
PATTERN_BEHIND = f"{PATTERN}|{NAME_BEHIND}"


#: What a name's mention may end with and its key doesn't have.
POSSESSIVE = "(['’][sS])$"


def hinted(text: Column) -> Column:
    """Whether a text may have an entity; most have none and are looked through once, by cheap tests."""
    return text.rlike(HINT) | text.rlike(HINT_WORDS) | ((F.octet_length(text) > F.length(text)) & text.rlike(HINT_OTHER))


def lit(text: str) -> Column:
    return F.lit(text)


def kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email")
        .when(whole(NAME), "name")
        .when(whole(NAME_BEHIND), "name_behind")
        .when(whole(MAC), "mac")
        .when(whole(IPV6), "ipv6")
        .when(whole(IPV4), "ipv4")
        .when(whole(IBAN), "iban")
        .when(whole(SSN), "ssn")
        .when(whole(CARD), "card")
        .when(whole(PHONE), "phone")
        .otherwise("secret")
    )


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def full_ipv6(address: Column) -> Column:
    """Eight groups of four."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left = groups(F.substring_index(address, "::", 1))
    right = F.when(address.contains("::"), groups(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def keys(m: Column, type_: Column) -> Column:
    """The keys of a mention: structs of type and key; two for an e-mail (local part at domain, domain), one for each word of a name."""

    def key(t: Column | str, k: Column) -> Column:
        return F.struct((lit(t) if isinstance(t, str) else t).alias("type"), k.alias("key"))

    low = F.lower(m)
    words = F.split(F.regexp_replace(F.regexp_replace(m, POSSESSIVE, ""), r"^\S+ ", ""), " ")
    # of a mention's ends only, as this is asked for each word of it
    head, tail = F.substring(m, F.lit(1), F.lit(14)), F.right(m, F.lit(2))
    gender = F.when(head.rlike(rf"^(?:(?:{FEMALE})\.?|{FEMALE_UNCASED}) ") | tail.rlike(f"(?:{FEMALE_BEHIND})$"), "f").when(tail.rlike("(?:さん|様|씨|님)$"), "n").otherwise("m")
    of_given = F.concat(lit("given_"), gender)
    surname = key("surname", F.lower(F.element_at(words, -1)))
    given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: key(of_given, F.lower(w)))
    body = F.regexp_replace(m, f" ?(?:{BEHIND})$", "")
    at = F.when(body.rlike(r"\p{IsKatakana}"), F.length(body)).when(F.length(body) > 3, 2).otherwise(1)
    behind = F.array(key("surname", F.substring(body, F.lit(1), at)), key(of_given, F.substring(body, at + 1, F.length(body))))
    return (
        F.when(type_ == "email", F.array(key("email", low), key("domain", F.substring_index(low, "@", -1))))
        .when(type_ == "name", F.concat(given, F.array(surname)))
        .when(type_ == "name_behind", F.filter(behind, lambda k: k["key"] != ""))
        .when(type_.isin("phone", "card", "ssn"), F.array(key(type_, digits(m))))
        .when(type_ == "iban", F.array(key("iban", F.regexp_replace(m, " ", ""))))
        .when(type_ == "mac", F.array(key("mac", low)))
        .when(type_ == "ipv6", F.array(key("ipv6", full_ipv6(low))))
        .otherwise(F.array(key(type_, m)))
    )


def stream(secret: str, *parts: Column) -> Column:
    """256 hexadecimal characters, or three for each one of the last part if that is more, drawn from the parts."""
    last = F.ceil((F.length(parts[-1]) * 3 + 4) / 64).cast("int") - 1
    block = lambda i: F.sha2(F.concat_ws("\u001f", lit(secret), *parts, i.cast("string")).cast("binary"), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(3))), block), "")


def drawn(hexes: Column, i: Column | int) -> Column:
    """The i-th number (from 1), 0 to 4095."""
    at = (((i if isinstance(i, Column) else F.lit(i)) - 1) * 3) % (F.length(hexes) - 4) + 1
    return F.conv(F.substring(hexes, at, F.lit(3)), 16, 10).cast("int")


def pick(letters: str, r: Column) -> Column:
    return F.substring(lit(letters), r % len(letters) + 1, F.lit(1))


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII = r"^[\x00-\x7F]*$"


def shaped(key: Column, hexes: Column, fixed: Column, hexadecimal: Column) -> Column:
    """The key with each letter and digit after the first `fixed` characters drawn anew in its own class."""

    def one(c: Column, at: Column, ascii_: bool) -> Column:
        i = at + 1
        r = drawn(hexes, i)
        out = (
            F.when(i <= fixed, c)
            .when(c.rlike("[0-9]"), (r % 10).cast("string"))
            .when(hexadecimal & c.rlike("[a-f]"), pick("abcdef", r))
            .when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF", r))
            .when(c.rlike("[a-z]"), pick(LOWER, r))
            .when(c.rlike("[A-Z]"), pick(UPPER, r))
        )
        if not ascii_:
            for script, (letters, *_) in SCRIPTS.items():
                drawn_ = pick(letters, r)
                out = out.when(c.rlike(rf"[\p{{L}}&&\p{{Is{script}}}]"), F.when(c.rlike(r"\p{Lu}"), F.upper(drawn_)).otherwise(drawn_))
            out = out.when(c.rlike(r"\p{Lu}"), pick(UPPER, r)).when(c.rlike(r"\p{L}"), pick(LOWER, r)).when(c.rlike(r"\p{N}"), (r % 10).cast("string"))
        return out.otherwise(c)

    letters = F.split(key, "")
    plain = F.transform(letters, lambda c, at: one(c, at, True))
    return F.array_join(F.when(key.rlike(ASCII), plain).otherwise(F.transform(letters, lambda c, at: one(c, at, False))), "")


def checksum(number: Column) -> Column:
    """The sum of which a valid card number's is a multiple of ten."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def syllables(hexes: Column, n: Column, consonants: str, vowels: str) -> Column:
    def one(i: Column) -> Column:
        r = drawn(hexes, i)
        return F.concat(pick(consonants, r), pick(vowels, F.floor(r / len(consonants)).cast("int"))) if vowels else pick(consonants, r)

    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def name(type_: Column, key: Column, attempt: Column, hexes: Column) -> Column:
    """A name of the key's script, longer with each attempt."""

    def whole(consonants: str, vowels: str, female: str, male: str) -> Column:
        n = F.lit(2) + attempt if vowels else F.length(key) + attempt
        return F.concat(syllables(hexes, n, consonants, vowels), F.when(type_ == "given_f", female).when(type_ == "given_m", male).otherwise(""))

    out = F.when(key.rlike(ASCII), whole("bcdfghjklmnprstvz", "aeiou", "na", "n"))
    for script, (_, *parts) in SCRIPTS.items():
        out = out.when(key.rlike(rf"\p{{Is{script}}}"), whole(*parts))
    return out.otherwise(whole("bcdfghjklmnprstvz", "aeiou", "na", "n"))


def surrogate(type_: Column, key: Column, attempt: Column, hexes: Column) -> Column:
    last = F.length(F.substring_index(key, ".", -1)) + 1  # a domain's top level stays
    body, top = F.substring(key, F.lit(1), F.length(key) - last), F.substring(key, F.length(key) - last + 1, last)
    hexadecimal = type_.isin("mac", "ipv6") | (key.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & ~type_.isin("email", "domain"))
    prefix = F.length(F.regexp_extract(key, "^(AKIA|gh[pousr]_|sk-)", 1))
    wide, widest = attempt >= WIDER, attempt >= WIDEST
    fixed = F.when(((type_ == "phone") & ~wide) | (type_ == "card"), 1).when(type_ == "iban", 2).when(type_ == "secret", prefix).otherwise(0)
    plain = shaped(F.when(type_ == "email", F.substring_index(key, "@", 1)).when(type_ == "domain", body).otherwise(key), hexes, fixed, hexadecimal)
    card = F.substring(plain, F.lit(1), F.length(plain) - 1)
    valid = F.concat(card, ((10 - checksum(F.concat(card, lit("0"))) % 10) % 10).cast("string"))
    octets = F.concat_ws(".", *((drawn(hexes, i) % 199 + 11 if i == 1 else drawn(hexes, i) % 254 + 1).cast("string") for i in range(1, 5)))
    extra = F.transform(F.sequence(F.lit(1), F.greatest(attempt - WIDER + 1, F.lit(1))), lambda i: drawn(hexes, i + 42))
    letters = F.when(wide, F.array_join(F.transform(extra, lambda r: pick(LOWER, r)), "")).otherwise("")
    figures = F.array_join(F.transform(extra, lambda r: (r % 10).cast("string")), "")
    named = name(type_, key, attempt, hexes)
    named = F.when(key.contains("-"), F.concat(named, lit("-"), name(type_, key, attempt, F.reverse(hexes)))).otherwise(named)
    # a secret of signs alone has no class to be drawn from
    signs = (type_ == "secret") & ~key.rlike(r"[\p{L}\p{N}]")
    worded = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(8))), lambda i: pick(LOWER, drawn(hexes, i))), "")
    longer = (wide & ((type_ == "secret") | ((type_ == "phone") & (F.length(key) < 10)))) | widest & type_.isin("phone", "card", "ssn", "iban", "ipv4", "ipv6", "mac")
    core = (
        F.when(type_.startswith("given_") | (type_ == "surname"), named)
        .when(signs, worded)
        .when(type_ == "ipv4", octets)
        .when(type_ == "email", F.concat(plain, letters))
        .when(type_ == "domain", F.concat(plain, letters, top))
        .when((type_ == "card") & (checksum(key) % 10 == 0), valid)
        .otherwise(plain)
    )
    return F.concat(core, F.when(longer, figures).otherwise(""))


def table_of_surrogates(found: DataFrame, secret: str) -> DataFrame:
    """type, key, core: a surrogate for each distinct key, none of which another key has or is itself a key found."""

    def with_core(rows: DataFrame) -> DataFrame:
        # the hashes as a column of their own, so that they are computed once a key
        hexes = stream(secret, F.col("type"), F.col("attempt").cast("string"), F.col("key"))
        rows = rows.withColumn("hexes", hexes).withColumn("core", surrogate(F.col("type"), F.col("key"), F.col("attempt"), F.col("hexes")))
        return rows.select("type", "key", "attempt", "core")

    # few bytes but much work: dealt out by an explicit count, which isn't coalesced
    # (by a hash of its own, as one by the keys themselves would be taken for that of distinct(), which is)
    keys_ = found.select("type", "key").distinct().repartition(partitions(found.sparkSession), F.xxhash64("type", "key"))
    table = written(with_core(keys_.withColumn("attempt", F.lit(0))), "surrogates")
    # an e-mail's local part must differ within a domain; all others within their type
    scope = F.when(F.col("type") == "email", F.substring_index("key", "@", -1)).otherwise(lit(""))
    while True:
        taken = table.select("type", F.col("key").alias("real"), F.lit(True).alias("is_real"))
        same = F.row_number().over(Window.partitionBy("type", scope, "core").orderBy("attempt", "key"))
        judged = table.withColumn("turn", same).withColumn("real", F.when(F.col("type") == "email", F.concat("core", lit("@"), scope)).otherwise(F.col("core")))
        judged = judged.join(taken, ["type", "real"], "left")
        # characters of no class (or none drawn) can't change
        fixed = ~F.col("key").rlike(r"[\p{L}\p{N}]") & (F.col("type") != "secret")
        bad = ((F.col("turn") > 1) | F.col("is_real").isNotNull()) & ~fixed
        judged = written(judged.select("type", "key", "attempt", "core", bad.alias("bad")), "judged", [table])
        if not judged.filter("bad").limit(1).count():
            return judged.select("type", "key", "core")
        again = with_core(judged.filter("bad").select("type", "key", (F.col("attempt") + 1).alias("attempt")))
        table = written(judged.filter("not bad").select("type", "key", "attempt", "core").union(again), "surrogates", [judged])


def in_format(m: Column, cores: Column, type_: Column) -> Column:
    """The surrogate in a mention's format; cores in the order of its keys."""
    core = cores[0]
    upper = (F.upper(m) == m) & (F.lower(m) != m)

    def cased(x: Column) -> Column:
        return F.when(upper, F.upper(x)).otherwise(x)

    def titled(x: Column) -> Column:
        return F.replace(F.initcap(F.replace(x, lit("-"), lit("- "))), lit("- "), lit("-"))

    # a mention's digits (or letters and digits) one after another, and what the surrogate has more
    def refilled(pattern: str) -> Column:
        sign = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.substring(m, i, F.lit(1)))
        start = F.struct(F.lit(1).alias("at"), lit("").alias("out"))
        step = lambda a, c: F.when(c.rlike(pattern), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substring(core, a["at"], F.lit(1))).alias("out"))).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
        return F.aggregate(sign, start, step, lambda a: F.concat(a["out"], F.substring(core, a["at"], F.length(core))))

    return (
        F.when(type_ == "email", cased(F.concat(core, lit("@"), cores[1])))
        .when(type_ == "name_behind", F.concat(F.array_join(cores, ""), F.regexp_extract(m, f"( ?(?:{BEHIND}))$", 1)))
        .when(type_ == "name", F.concat(F.regexp_extract(m, r"^(\S+ )", 1), cased(titled(F.array_join(cores, " "))), F.regexp_extract(m, POSSESSIVE, 1)))
        .when(type_.isin("phone", "card", "ssn"), refilled("[0-9]"))
        .when(type_ == "iban", refilled("[A-Z0-9]"))
        .when(type_.isin("mac", "ipv6"), cased(core))
        .otherwise(core)
    )


def mentions(docs: DataFrame) -> DataFrame:
    """kid, th, pos, mention, type: every entity of each distinct document, in order."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("kid"), F.xxhash64(text).alias("th"), text.alias("text")).filter(hinted(F.col("text")))
    each = F.when(F.col("text").rlike(HINT_BEHIND), F.regexp_extract_all("text", lit(PATTERN_BEHIND), F.lit(0))).otherwise(F.regexp_extract_all("text", lit(PATTERN), F.lit(0)))
    found = rows.select("kid", "th", F.posexplode(each).alias("pos", "mention"))
    return found.withColumn("type", kind(F.col("mention")))


def replaced(docs: DataFrame, secret: str = "corpus") -> tuple[DataFrame, str]:
    """docs with surrogates in text and a further column, whose name is returned, with the number of entities."""
    every = written(mentions(docs).distinct(), "mentions")
    parts = every.select("kid", "th", "pos", "mention", "type", F.posexplode(keys(F.col("mention"), F.col("type"))).alias("part", "k")).select("kid", "th", "pos", "mention", F.col("type").alias("of"), "part", "k.*")
    table = table_of_surrogates(parts, secret)
    known = parts.join(table, ["type", "key"]).groupBy("kid", "th", "pos", "mention", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "core"))), lambda x: x["core"]).alias("cores"))
    known = known.select("kid", "th", "pos", in_format(F.col("mention"), F.col("cores"), F.col("of")).alias("to"))
    by_doc = written(known.groupBy("kid", "th").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("tos")), "replaced")
    kid, th, tos = (free_name(docs, c) for c in ("kid", "th", "tos"))
    by_doc = by_doc.toDF(kid, th, tos)
    # a row's strings and their headers, as a hash table holds them
    weight = by_doc.select(F.sum(96 + F.aggregate(tos, F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x))).alias("w")).first()["w"] or 0
    by_doc = F.broadcast(by_doc) if weight <= BROADCAST_BYTES else by_doc
    rows = docs.withColumn(kid, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).withColumn(th, F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(by_doc, [kid, th], "left")
    # null where nothing is to be replaced: such texts aren't searched a second time, and others once
    kept = F.when(F.col(tos).isNotNull(), F.col("text"))
    between = F.when(kept.rlike(HINT_BEHIND), F.split(kept, PATTERN_BEHIND, -1)).otherwise(F.split(kept, PATTERN, -1))
    whole = F.array_join(F.zip_with(between, F.concat(F.col(tos), F.array(F.lit(""))), lambda kept, to: F.concat(kept, to)), "")
    n = free_name(docs, "n_entities")
    out = joined.withColumn(n, F.coalesce(F.size(tos), F.lit(0)).cast("long")).withColumn("text", F.when(F.col(tos).isNull(), F.col("text")).otherwise(whole))
    out = out.withColumn(n, F.greatest(F.col(n), F.lit(0)).cast("long"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(tos).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, n), n


def surrogates(docs: DataFrame, secret: str = "corpus") -> DataFrame:
    """The rows and columns of docs, with surrogates in text; n_chars, where there is one, is counted anew."""
    return replaced(docs, secret)[0].select(*docs.columns)


def surrogate_report(docs: DataFrame, secret: str = "corpus") -> DataFrame:
    """doc_id, n_entities and the text with surrogates."""
    out, n = replaced(docs.select("doc_id", "text"), secret)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(n).alias("n_entities"), "text")
