"""Personal data replaced by keyed surrogates of the same kind, in DataFrame functions only.

Detected: e-mail addresses, dotted quads, IPv6 addresses, telephone numbers (with +, 00 or 0 before them, grouped, or ten
bare digits of the North American plan), payment cards (13 to 19 digits that pass the Luhn check), account numbers (IBAN
that pass their check), national numbers (ddd-dd-dddd, also with blanks), secrets (32 to 64 hex digits, web tokens, keys
with known prefixes) and titled names. Each distinct entity gets one surrogate, made from SHA-256 of key, kind, value and
attempt. The key is given, or stands in the session's spark.quillspark.surrogate.key or in the environment's
QUILLSPARK_SURROGATE_KEY; without one it is an error. Who holds the key can redo the mapping, nobody else.

- digits become digits and letters letters of the same case and script, punctuation and length stay; cards and account
  numbers keep their checks, quads stay quads, telephone numbers keep their country code, e-mail addresses their top-level domain;
- e-mail addresses that differ only in case, and numbers that differ only in punctuation or in a leading +1, are one
  entity; secrets are case-sensitive; every mention keeps its own case and punctuation;
- a name's words are replaced one by one, so that "Mr. John Smith", "MR JOHN SMITH" and "Mr Smith" stay one person and
  relatives share their surname. Words keep their script (Latin, Greek, Cyrillic) and the mention's capitals; given names
  end by gender, as the titles beside them say. Titles, particles (von, de) and a
  possessive's 's stay. Initials are exchanged by a keyed cycle of the alphabet.
- a document that names somebody with a title is searched for the same words in any case and, for two words or more,
  without a title; also for the surname alone or behind initials, with a capital or in capitals. A name never given with a
  title, or only in small letters, is not detected.

Collision check: a surrogate that two entities share, or that occurs as an entity itself, is drawn again with the
next attempt for all but one of them, until none is left; distinct entities stay distinct. After a few attempts words
grow by a letter, so that short formats can't run out. Numbers that can't grow raise after ATTEMPTS rounds.

Texts without an entity pass unchanged, without a shuffle. Null and empty texts pass. Null ids and repeated rows are
kept. All other columns are kept, whatever their names; n_chars, if there, follows the new text.
"""

from __future__ import annotations

import hashlib
import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C

ATTEMPTS = 24
BROADCAST_BYTES = 32 << 20
SETTING, VARIABLE = "spark.quillspark.surrogate.key", "QUILLSPARK_SURROGATE_KEY"

#: Titles by gender (male, female, unknown), and particles of names.
TITLES = ("Mr|Herr|Monsieur|Señor|Sr|Signor|Sir", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Lady", "Dr|Prof|Mx")
#: Country codes of one and two digits; all others have three.
COUNTRY = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
PARTICLES = "von|van|de|del|della|di|da|la|le|du|der|den|zu"
TITLE = "|".join((*TITLES, *(t.upper() for t in TITLES)))
WORD = r"\p{Lu}(?:\.(?= \p{Lu})|[\p{L}\p{M}]*(?:['’-](?![sS](?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*)*)"
PLACED = rf"(?:(?:{PARTICLES}) ){{0,2}}{WORD}"
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]*(?![0-9A-Za-z:]))(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}(?:-\d{2}-|(?<!\d \d{3}) \d{2} )\d{4}(?![\d-]| \d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d+])(?=\+(?:[ .()-]*\d){8,15}(?!\d|[ .()-]\d))\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){1,6}(?:[ .-]?\d{1,8})?(?!\d)|(?<![\w.+-])(?=00[1-9](?:[ .()-]*\d){7,14}(?!\d|[ .()-]\d))00\d{1,3}(?:[ .-]\(?\d{1,4}\)?){1,6}(?:[ .-]?\d{1,8})?(?!\d)|(?<![\w.,+-])(?<!\d )0[1-9]\d{1,3}[ /-]\d{5,8}(?![\w-]|[ .,/]\d)|(?<![\w.,+-])(?<!\d )[2-9]\d{2}[2-9]\d{6}(?![\w-]|[ .,]\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{TITLE})\.? {PLACED}(?: {PLACED}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these can't hold an entity (titles start names). One look at the first letter spares trying all titles.
HINT = rf"[0-9@]|(?=[{''.join(sorted({t[0] for t in TITLE.split('|')}))}])(?:{TITLE})\.? (?:\p{{Lu}}|(?:{PARTICLES}) )|[a-fA-F]{{32}}|sk-|gh[pousr]_|AIza|eyJ"


def _raw(pattern: str) -> str:
    """A SQL raw literal of a pattern."""
    return "r'" + pattern.replace(chr(39), chr(92) + "x27") + "'"


def _kind(value: str) -> str:
    """What matches no pattern by itself is a name that its document gives with a title elsewhere."""
    return "case " + " ".join(f"when {value} rlike {_raw(f'^(?:{p})$')} then '{k}'" for k, p in PATTERNS.items()) + " else 'name' end"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string is a multiple of 10."""
    return f"""aggregate(transform(sequence(1, length({digits})), i -> cast(substring({digits}, length({digits}) + 1 - i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, (s, x) -> s + if(x > 9, x - 9, x)) % 10 = 0"""


def _iban_rest(account: str) -> str:
    """SQL: an account number without blanks modulo 97, its first four characters read last."""
    turned = f"concat(substring({account}, 5), left({account}, 4))"
    return f"aggregate(transform(sequence(1, length({turned})), i -> substring({turned}, i, 1)), 0, (s, c) -> if(c between '0' and '9', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _canon(kind: str, value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return f"""case when {kind} in ('card', 'ssn') then {digits} when {kind} = 'iban' then replace({value}, ' ', '')
        when {kind} = 'phone' then case when {digits} like '1__________' then right({digits}, 10) when {value} like '00%' then concat('+', substring({digits}, 3)) else concat(if({value} like '+%', '+', ''), {digits}) end
        when {kind} in ('name', 'secret') then {value} else lower({value}) end"""


def _chars(value: str, draw: str, first: int = 1) -> str:
    """SQL: every letter and digit of value from position first on replaced by one of its class, drawn from hex string draw."""
    pick = f"cast(conv(substring({draw}, ((i - 1) % 31) * 2 + 1, 2), 16, 10) as int) + cast((i - 1) div 31 as int) * 7"
    return f"""array_join(transform(sequence(1, length({value})), i -> case
        when i < {first} then substring({value}, i, 1)
        when substring({value}, i, 1) between '0' and '9' then cast(({pick}) % 10 as string)
        when substring({value}, i, 1) between 'a' and 'z' then char(97 + ({pick}) % 26)
        when substring({value}, i, 1) between 'A' and 'Z' then char(65 + ({pick}) % 26)
        else substring({value}, i, 1) end), '')"""


def _by_script(cyrillic: str, greek: str, latin: str) -> str:
    return f"if(canon rlike r'\\p{{IsCyrillic}}', '{cyrillic}', if(canon rlike r'\\p{{IsGreek}}', '{greek}', '{latin}'))"


def _byte(at: str) -> str:
    """SQL: the number in two hex digits of draw."""
    return f"cast(conv(substring(draw, {at}, 2), 16, 10) as int)"


def propose(rows: DataFrame, key: str) -> DataFrame:
    """The surrogate, in canonical form, that attempt proposes for each (kind, canon, attempt)."""
    rows = rows.withColumn("_key", F.lit(key))
    rows = rows.withColumn("draw", F.expr("sha2(concat_ws('|', _key, kind, canon, cast(attempt as string)), 256)"))
    rows = rows.withColumn("code", F.expr("sha2(concat_ws('|', _key, 'domain', substring_index(canon, '@', -1)), 256)"))
    rows = rows.withColumn("local", F.expr("concat(substring_index(canon, '@', 1), repeat('a', greatest(0, attempt - 2)))"))
    rows = rows.withColumn("host", F.expr("substring_index(canon, '@', -1)")).withColumn("labels", F.expr("left(host, greatest(0, length(host) - length(substring_index(host, '.', -1)) - 1))"))
    rows = rows.withColumn("stem", F.expr("left(canon, greatest(0, length(canon) - 1))")).withColumn("area", F.regexp_extract("canon", rf"^\+(?:{COUNTRY})", 0)).withColumn("tail", F.expr("substring(canon, length(area) + 1)"))
    rows = rows.withColumn("body", F.expr(_chars("stem", "draw", 2)))
    rows = rows.withColumn("account", F.expr(f"concat(left(canon, 2), '00', {_chars('substring(canon, 5)', 'draw')})"))
    rows = rows.withColumn("onset", F.expr(_by_script("бвгдклмнпрст", "βγδκλμνπρστ", "bdfgklmnprstv"))).withColumn("nucleus", F.expr(_by_script("аеиоу", "αειου", "aeiou"))).withColumn("coda", F.expr(_by_script("н", "ν", "n")))
    rows = rows.withColumn("ending", F.expr(f"case when canon like 'f:%' then {_by_script('а', 'α', 'a')} when canon like 'm:%' then {_by_script('ов', 'ος', 'o')} else coda end"))
    syllable = f"concat(substring(onset, 1 + {_byte('w * 12 + k * 4 + 1')} % length(onset), 1), substring(nucleus, 1 + {_byte('w * 12 + k * 4 + 3')} % length(nucleus), 1))"
    part = f"concat(array_join(transform(sequence(0, 2), k -> {syllable}), ''), ending, repeat(left(nucleus, 1), greatest(0, attempt - 4)))"
    hexes = "array_join(transform(sequence(1, length(canon)), i -> substring(draw, (i - 1) % 64 + 1, 1)), '')"
    made = {
        "email": f"concat({_chars('local', 'draw')}, '@', {_chars('labels', 'code')}, '.', substring_index(host, '.', -1))",
        "ip": "concat_ws('.', transform(sequence(0, 3), i -> cast(1 + cast(conv(substring(draw, i * 4 + 1, 4), 16, 10) as int) % 254 as string)))",
        "secret": f"case when canon rlike '^[0-9a-f]+$' then {hexes} when canon rlike '^[0-9A-F]+$' then upper({hexes}) else {_chars('canon', 'draw', 5)} end",
        "phone": f"concat(area, {_chars('tail', 'draw')})",
        "card": f"element_at(filter(transform(sequence(0, 9), d -> concat(body, cast(d as string))), c -> {_luhn('c')}), 1)",
        "word": f"array_join(transform(sequence(0, least(3, size(split(canon, '-')) - 1)), w -> {part}), '-')",
        "ssn": _chars("canon", "draw"),
        "ip6": "array_join(transform(sequence(1, length(canon)), i -> if(substring(canon, i, 1) = ':', ':', substring(draw, (i - 1) % 64 + 1, 1))), '')",
        "iban": f"concat(left(canon, 2), lpad(cast(98 - {_iban_rest('account')} as string), 2, '0'), substring(account, 5))",
    }
    return rows.withColumn("surrogate", F.expr("case kind " + " ".join(f"when '{k}' then {e}" for k, e in made.items()) + " end")).select("kind", "canon", "attempt", "surrogate")


#: A word's canonical form is its gender (m, f or none), a colon and the word in small letters.
REAL = "if(kind = 'word', substring_index(canon, ':', -1), canon)"


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """found (kind, canon), distinct, to a staged (kind, canon, surrogate) without collisions."""
    now = C.stage(propose(found.withColumn("attempt", F.lit(0)), key))
    for _ in range(ATTEMPTS):
        own = now.select("kind", F.expr(REAL).alias("surrogate"), F.lit(True).alias("real")).distinct()
        # of the entities that share a surrogate the first keeps it, unless it is a real value
        first = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("keeper"), F.count("*").alias("n"))
        clash = first.join(own, ["kind", "surrogate"], "left").filter("n > 1 or real").select("kind", "surrogate", F.when(F.col("real"), F.lit(None).cast("string")).otherwise(F.col("keeper")).alias("keeper"))
        clash = C.stage(clash)
        if not clash.limit(1).count():
            C.drop(clash)
            return now.select("kind", "canon", "surrogate")
        marked = now.join(clash.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.col("hit") & (F.col("keeper").isNull() | (F.col("keeper") != F.col("canon")))
        moved = marked.select("kind", "canon", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt"))
        new = C.stage(propose(moved, key))
        C.drop(clash, now)
        now = new
    raise ValueError("a format has too few values for its entities")


def _words(value: str) -> str:
    """SQL: the words of a name's mention, without its title."""
    return f"split(regexp_replace({value}, {_raw(f'^(?iu:{TITLE})' + chr(92) + '.? ')}, ''), ' ')"


def _is_name_word(w: str) -> str:
    return f"not ({w} rlike '^(?:{PARTICLES})$' or {w} rlike '^.[.]$')"


def word_canons(names: DataFrame) -> DataFrame:
    """(word, canon) of the words in mentions (value); a word takes the gender of the titles before it as a given name."""
    title = F.regexp_extract("value", rf"^(?iu:({TITLE}))\.? ", 1)
    of = lambda titles: title.rlike(f"^(?iu:{titles})$")
    gender = F.when(of(TITLES[0]), "m").when(of(TITLES[1]), "f").otherwise("")
    words = names.select("value").distinct().withColumn("gender", gender).withColumn("all", F.expr(f"filter({_words('value')}, w -> {_is_name_word('w')})"))
    each = words.select(F.size("all").alias("n"), "gender", F.posexplode("all").alias("at", "w")).select(F.lower("w").alias("word"), F.when((F.col("at") == 0) & (F.col("n") > 1), F.col("gender")).otherwise("").alias("g"))
    seen = each.groupBy("word").agg(F.max(F.col("g") == "m").alias("m"), F.max(F.col("g") == "f").alias("f"))
    return seen.select("word", F.concat(F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise(""), F.lit(":"), F.col("word")).alias("canon"))


def _shown_names(names: DataFrame, canons: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(value, shown) of the distinct mentions of names."""
    cycle = sorted(map(chr, range(65, 91)), key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest())
    after = "".join(cycle[(cycle.index(chr(c)) + 1) % 26] for c in range(65, 91))
    each = names.select("value").distinct().select("value", F.expr(f"{_words('value')}").alias("all")).select("value", F.posexplode("all").alias("at", "w"))
    each = each.join(canons, F.lower("w") == F.col("word"), "left").join(words.filter("kind = 'word'"), "canon", "left")
    proper = "array_join(transform(split(surrogate, '-'), p -> initcap(p)), '-')"
    cased = f"case when surrogate is null or not ({_is_name_word('w')}) then w when w = upper(w) and length(w) > 1 then upper(surrogate) when w = lower(w) then surrogate else {proper} end"
    moved = f"if(w rlike '^[A-Z][.]$', concat(substring('{after}', ascii(w) - 64, 1), '.'), {cased})"
    back = each.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("at", F.expr(moved).alias("x")))).alias("all"))
    return back.select("value", F.concat(F.regexp_extract("value", rf"^((?iu:{TITLE})\.? )?", 0), F.array_join(F.col("all.x"), " ")).alias("shown"))


def _name_patterns(names: DataFrame, id_column: str) -> DataFrame:
    """(id, pattern) of the texts that name somebody: the names' words again, in any case."""
    people = names.select(id_column, F.expr(_words("value")).alias("all")).groupBy(id_column).agg(F.collect_set("all").alias("people"))
    # the longest first; of the characters in names only the dot means something in a pattern
    full = F.expr("array_join(transform(array_sort(transform(filter(people, p -> size(p) > 1), p -> struct(-length(array_join(p, ' ')) as n, replace(array_join(p, ' '), '.', '[.]') as x))), s -> s.x), '|')")
    single = F.expr(f"array_join(array_distinct(transform(filter(flatten(people), w -> {_is_name_word('w')}), w -> replace(w, '.', '[.]'))), '|')")
    title = rf"(?<!\p{{L}})(?iu:{TITLE})\.? "
    whole = F.when(F.length("full") > 0, F.concat(F.lit(rf"(?:{title}|(?<!\p{{L}}))(?iu:"), F.col("full"), F.lit(r")(?!\p{L})|"))).otherwise("")
    alone = F.when(F.length("single") > 0, F.concat(F.lit(rf"(?!(?:{PATTERNS['name']})){title}(?iu:"), F.col("single"), F.lit(r")(?!\p{L})|"))).otherwise("")
    last = F.expr(f"array_join(array_distinct(flatten(transform(transform(people, p -> element_at(filter(p, w -> {_is_name_word('w')}), -1)), w -> array(w, upper(w))))), '|')")
    untitled = F.when(F.length("last") > 0, F.concat(F.lit(rf"(?!{PATTERNS['email']})(?<![\p{{L}}\p{{M}}@._-])(?:\p{{Lu}}\. ?){{0,2}}(?:"), F.col("last"), F.lit(r")(?![\p{L}\p{M}@_])|"))).otherwise("")
    people = people.withColumn("full", full).withColumn("single", single).withColumn("last", last)
    return people.select(id_column, F.concat(whole, alone, untitled, F.lit(ANY)).alias("pattern"))


def session_key(spark: SparkSession, draw: bool = False) -> str:
    """The key of surrogates from the session's or the environment's setting; absent, one is drawn for this session if asked, else it is an error."""
    found = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    if not found:
        if not draw:
            raise ValueError(f"set {SETTING} or {VARIABLE} to a secret key")
        found = secrets.token_hex(32)
        spark.conf.set(SETTING, found)
    return found


def replace(docs: DataFrame, key: str | None = None, count_column: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; count_column, if named, gets the number of mentions replaced. Without a key that of the session."""
    key = key or session_key(C.tune(docs.sparkSession))
    work = "_pii"
    while any(c.lower().startswith(work) for c in docs.columns):
        work = "_" + work
    text_id, found_by = f"{work}_id", f"{work}_pattern"
    counted = [count_column] if count_column else []
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = docs.filter(~hinted)
    for c in counted:
        plain = plain.withColumn(c, F.lit(0).cast("bigint"))
    risky = C.stage(docs.filter(hinted).withColumn(text_id, F.sha2("text", 256)))
    mentions = lambda rows, pattern: rows.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all("text", F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)))).alias("value")).distinct()
    typed = lambda values: values.withColumn("kind", F.expr(_kind("value"))).withColumn("canon", F.expr(_canon("kind", "value"))).filter(f"kind not in ('card', 'iban') or kind = 'card' and {_luhn('canon')} or kind = 'iban' and {_iban_rest('canon')} = 1")
    first = C.stage(typed(mentions(risky, F.lit(ANY))))
    patterns = C.stage(_name_patterns(first.filter("kind = 'name'"), text_id).withColumnRenamed("pattern", found_by))
    again = risky.join(_sized(patterns), text_id)
    kinds = C.stage(first.join(patterns, text_id, "left_anti").union(typed(mentions(again, F.col(found_by)))))
    names = kinds.filter("kind = 'name'")
    canons = C.stage(word_canons(names))
    entities = kinds.filter("kind <> 'name'").select("kind", "canon").distinct().union(canons.select(F.lit("word").alias("kind"), "canon"))
    words = dictionary(entities, key)
    digits = "array_join(transform(sequence(1, length(value)), i -> if(substring(value, i, 1) between '0' and '9' and length(regexp_replace(substring(value, i), '[^0-9]', '')) <= length(surrogate), substring(surrogate, length(surrogate) + 1 - length(regexp_replace(substring(value, i), '[^0-9]', '')), 1), substring(value, i, 1))), '')"
    cased = "if(length(value) = length(surrogate), array_join(transform(sequence(1, length(value)), i -> if(substring(value, i, 1) between 'A' and 'Z', upper(substring(surrogate, i, 1)), substring(surrogate, i, 1))), ''), if(value = upper(value), upper(surrogate), surrogate))"
    digits = digits.replace("surrogate", "replace(surrogate, '+', '')")
    spaced = "array_join(transform(sequence(1, length(value)), i -> if(substring(value, i, 1) = ' ', ' ', substring(surrogate, length(replace(left(value, i), ' ', '')), 1))), '')"
    shown = f"case when kind in ('phone', 'card', 'ssn') then {digits} when kind in ('email', 'ip6') then {cased} when kind = 'iban' then {spaced} else surrogate end"
    others = kinds.filter("kind <> 'name'").join(_sized(words), ["kind", "canon"]).select(text_id, "value", F.expr(shown).alias("shown"))
    named = names.select(text_id, "value").join(_shown_names(names, canons, words, key), "value").select(text_id, "value", "shown")
    per_text = others.union(named).groupBy(text_id).agg(F.map_from_entries(F.collect_set(F.struct("value", "shown"))).alias(f"{work}_map"))
    fixed = risky.join(per_text, text_id, "left").join(_sized(patterns), text_id, "left")
    mine = F.coalesce(F.col(found_by), F.lit(ANY))
    fixed = fixed.withColumn(f"{work}_found", F.regexp_extract_all("text", F.concat(F.lit("("), mine, F.lit(")")), F.lit(1))).withColumn(f"{work}_parts", F.split("text", mine, -1))
    swapped = f"array_join(zip_with({work}_parts, {work}_found, (p, e) -> concat(p, coalesce({work}_map[e], e, ''))), '')"
    fixed = fixed.withColumn("text", F.when(F.col(f"{work}_map").isNotNull(), F.expr(swapped)).otherwise(F.col("text")))
    for c in counted:
        fixed = fixed.withColumn(c, F.coalesce(F.size(F.filter(f"{work}_found", lambda e: F.col(f"{work}_map")[e].isNotNull())).cast("bigint"), F.lit(0).cast("bigint")))
        fixed = fixed.withColumn(c, F.greatest(F.col(c), F.lit(0).cast("bigint")))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(F.col(f"{work}_map").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return plain.unionByName(fixed.select(*docs.columns, *counted))


def _sized(side: DataFrame) -> DataFrame:
    """Marks a side of strings for broadcast if its bytes fit; otherwise the join shuffles."""
    held = sum((F.octet_length(c) for c in side.columns), F.lit(32 * (1 + len(side.columns))))
    return F.broadcast(side) if int(side.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES else side


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace(docs.select("doc_id", "text"), session_key(spark, draw=True), count_column="n_replaced")
