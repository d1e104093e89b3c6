"""Rules on card texts: evidence flags, rule verdicts, facts, product types, features of read texts, explanations.

Each is a table of patterns and phrases, turned into Column expressions. A pattern is written once, with \\w, \\b and \\s
in their Unicode sense; java() and portable() give the forms that Spark and engines without look-around read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, patterns and phrases are part of the task's definition.
SUPPLEMENT, FLAMMABLE = "БАД", "Легковоспламеняющиеся"
PATTERNS = {
    "supplement_mark": r"биологически\s+активн|дietary\s+supplement|dietary\s+supplement|бад\s+к\s+пище|свидетельств\w*\s+о\s+государственной\s+регистрации|сгр\b",
    "supplement_word": r"\bбад\w*\b|\bbad\b",
    "sport_nutrition": r"спортивн\w+\s+питани|bcaa|всаа|л[-\s]?карнитин|l[-\s]?carnitine|протеин|изолят\s+сыворот|гейнер|креатин|предтрениров|whey|аминокислотн\w+\s+комплекс",
    "not_supplement": r"не\s+являет\w*\s+(?:бад|биологически)",
    "mark_ru": r"биологически\s*активн\w*\s*добавк|бад\s*к\s*пище|свидетельств\w*\s+о\s+государственной\s+регистрации",
    "mark_ru_denied": r"не\s+являе\w*[^.]{0,60}\bбад\b",
    "mark_en": r"dietary\s*suppl|\bsuppl\w*",
    "ignition": r"\bспичк|\bспичек|зажигалк|розжиг|растопк|сухое\s+горюч|горюч\w+\s+таблет|фитил|бенгальск\w+\s+огн|петард|фейерверк|дымов\w+\s+шашк|цветной\s+дым|хлопушк",
    "fuel": r"баллон\w*\s+(?:с\s+)?газ|газ\w*\s+в\s+баллон|мапп[-\s]?газ|бутан|пропан|бензин|керосин|уайт[-\s]?спирит|жидкост\w+\s+для\s+розжига|спирт\w+\s+горюч|топлив\w+\s+для|уголь\s+древесн|брикет\w*\s+древесн",
    "in_kit": r"в\s+комплект\w*[^.]{0,80}(?:угол|уголь|газ|спичк|розжиг|горюч)|комплектаци\w*[^.]{0,80}(?:угол|уголь|газ|спичк|розжиг|горюч)|\+\s*\d*\s*(?:цанговы\w+\s+)?баллон",
    "device": r"\bмангал|\bгриль|барбекю|\bжаровн|газов\w+\s+плит|горелк|паяльн\w+\s+ламп|\bрезак\b|\bкамин|\bпечь|\bпечк|коптильн|таган",
    "accessory": r"чехол|футляр|подставк|держател|опахало|веер\b|кофр|брелок|сувенир|прикол|игрушк|спичечниц|пепельниц|решётк|решетк|шампур|щипц|перчатк|салфетк|наклейк|без\s+спичек|без\s+газа|без\s+топлива|газ\s+не\s+вход|в\s+комплект\w*\s+не\s+вход",
}
#: flag, part of the card, pattern
EVIDENCE = [
    ("supplement_mark", "text", "supplement_mark"), ("supplement_mark_ocr", "ocr", "supplement_mark"), ("ocr_mark_ru", "ocr", "mark_ru"), ("ocr_mark_en", "ocr", "mark_en"), ("ocr_sport", "ocr", "sport_nutrition"),
    ("supplement_word", "text", "supplement_word"), ("sport_nutrition", "text", "sport_nutrition"), ("explicit_not_supplement", "text", "not_supplement"),
    ("ignition_source_name", "name", "ignition"), ("fuel_content_name", "name", "fuel"), ("device_for_fire", "name", "device"), ("accessory", "name", "accessory"),
    ("ignition_source", "full", "ignition"), ("fuel_content", "full", "fuel"), ("in_kit", "full", "in_kit"),
]
LANGUAGE_FLAGS = ("ocr_mark_ru", "ocr_mark_en", "ocr_sport")
#: key, phrase, part of the card, pattern
FACTS = {
    FLAMMABLE: [
        ("no_fire_near", "в описании есть предупреждение хранить вдали от огня", "whole", r"вдали от (?:огня|источник)|беречь от огня|огнеопасн"),
        ("no_kit", "в описании оговорено, что горючее или баллон НЕ входит в комплект", "whole", r"без баллона|без газа|без спичек|без топлив|без угл[яе]|не вход(?:ит|ят)|не включен|в комплект не|баллон не |газ не входит"),
        ("adapter", "у товара есть переходник или адаптер под внешний баллон", "whole", r"переходник|адаптер"),
        ("piezo", "у товара есть пьезоподжиг", "whole", r"пьезо"),
        ("device_head", "название начинается с устройства: плита, мангал, гриль, горелка", "name", r"^\s*(?:газов\w+\s+)?(?:плит\w+|мангал\w*|грил[ья]?|барбекю|горелк\w+|печ[ьи]|коптильн\w+|таганок)"),
        ("gost", "в карточке указан ГОСТ", "whole", r"\bгост\b"),
        ("refillable", "изделие заправляемое или перезаправляемое", "whole", r"заправляем\w+|перезаправ\w+|для заправки"),
        ("substance_head", "название начинается с самого вещества: уголь, топливо, газ, спички", "name", r"^\s*(?:угол[ья]|уголь|брикет\w*|топлив\w+|газ\b|бензин\w*|спичк\w+|розжиг\w*|растопк\w+|сух\w+\s+горюч\w+|жидкость для)"),
        ("pack_set", "в названии указана упаковка, набор или блок", "name", r"упаковк|набор|блок|компл"),
        ("popper", "карточка описывает хлопушку, конфетти или серпантин", "whole", r"пневматическ\w+|конфетти|серпантин|язычк\w+"),
    ],
    SUPPLEMENT: [("not_supplement", "в описании прямо сказано, что товар НЕ является биологически активной добавкой", "whole", r"не\s+являе\w*[^.]{0,60}\b(?:бад|биологически активн)")],
}
FACT_KEYS = [k for rules in FACTS.values() for k, *_ in rules]
FACTS_HEAD, READ_FACT = "Замечено в карточке (наблюдения, могут быть неточны):", "на фотографиях распознан текст: "
TYPES = [
    ("accessory_empty", r"чехол|футляр|подставк|держател|брелок|спичечниц|без спичек|без газа|газ не вход|не входит в комплект"),
    ("souvenir_toy", r"сувенир|прикол|игрушк|шокер|фонарик"),
    ("pyro", r"хлопушк|петард|фейерверк|салют|бенгальск|дымов|цветной дым|страйкбол|граната"),
    ("matches", r"\bспичк|\bспичек|\bспички"),
    ("lighter", r"зажигалк"),
    ("firestarter", r"розжиг|растопк|сухое горюч|таблетк\w* горюч|супер[- ]?ролл|роллы"),
    ("gas_container", r"баллон|мапп|цанговы|пропан|бутан"),
    ("flammable_liquid", r"бензин|керосин|уайт[- ]?спирит|спирт|топлив|жидкост\w* для розжиг"),
    ("charcoal", r"\bугол|\bуголь|брикет"),
    ("candle", r"свеч"),
    ("burner", r"горелк|резак|паяльн"),
    ("grill", r"мангал|гриль|барбекю|жаровн|коптильн|таган|шампур"),
    ("stove", r"плит|печь|печк|камин|котёл|котел"),
]
TYPE_NAMES = [k for k, _ in TYPES] + ["other"]
READ_FLAGS = {
    "ocr_supplement_mark": PATTERNS["supplement_mark"],
    "ocr_supplement_word": PATTERNS["supplement_word"],
    "ocr_dietary": r"d\w{0,2}etary\s+su\w+",
    "ocr_hazard": r"огнеопас|легковоспламен|взрывоопас|hazard|flammable",
    "ocr_gost": r"\bгост\b|\bту\b\s*\d",
    "ocr_sgr": r"свидетельств\w+\s+о\s+гос|\bсгр\b|au\.\d{2}\.",
}
#: flags in order with their phrases, the phrase where none holds, the closing sentence; by (is a supplement, fits its category)
REASONS = {
    (True, 1): ([("supplement_mark_ocr", "на изображении упаковки видна маркировка биологически активной добавки"), ("supplement_mark", "в описании есть прямое указание «биологически активная добавка к пище»"), ("supplement_word", "карточка прямо обозначает товар как БАД")], "состав и назначение соответствуют биологически активной добавке", "Товар относится к категории БАД, карточка заполнена корректно."),
    (True, 0): ([("explicit_not_supplement", "в описании прямо сказано, что товар не является БАД"), ("sport_nutrition", "товар отнесён к спортивному питанию, а оно к БАД не относится")], "ни в тексте, ни на изображениях нет маркировки БАД или dietary supplement", "Отнести товар к категории БАД нельзя."),
    (False, 1): ([("fuel_content_name", "товар содержит горючее вещество или газ"), ("ignition_source_name", "товар сам является источником открытого огня"), ("in_kit", "в комплект входит горючее содержимое"), ("fuel_content", "в составе товара указано горючее вещество")], "товар относится к горючим изделиям по составу и назначению", "Товар относится к легковоспламеняющимся, категория указана верно."),
    (False, 0): ([("device_for_fire", "это устройство для использования с огнём, а само по себе оно не горючее"), ("accessory", "это аксессуар или тара без горючего содержимого")], "источника воспламенения и горючего содержимого не выявлено", "К легковоспламеняющимся товар не относится."),
}
PYRO, AIR = r"хлопушк|дымов\w* шашк|цветн\w* дым|дымов\w* фонтан|шашк\w* дымов", r"пневматич|сжат\w* воздух|без пиротехн"
# End of the fixed values.


def java(pattern: str) -> str:
    return f"(?iU){pattern}"


def portable(pattern: str) -> str:
    """The same for engines whose \\w and \\b know ASCII only; matches where the other finds something."""
    word = r"\p{L}\p{N}_"
    out = pattern.replace(r"[^.]{0,60}\b", f"[^.]{{0,59}}[^.{word}]").replace(r"\b\s*\d", r"\s+\d")
    out = re.sub(r"(^|[|(\]])\\b(?=[^|)$])", lambda m: f"{m[1]}(?:^|[^{word}])", out)
    out = out.replace(r"\b", f"(?:$|[^{word}])")
    out = out.replace(r"\w", f"[{word}]").replace(r"[-\s]", r"[-\s\p{Z}]").replace(r"\d", r"\p{Nd}")
    return "(?i)" + re.sub(r"(?<!-)\\s", r"[\\s\\p{Z}]", out)


def found(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def parts(name: Column, description: Column, ocr: Column) -> dict[str, Column]:
    text = F.concat(name, F.lit(" \n "), description)
    return {"name": name, "text": text, "ocr": ocr, "full": F.concat(text, F.lit(" \n "), ocr), "whole": F.concat(name, F.lit(" "), description)}


def evidence(name: Column, description: Column, ocr: Column, languages: bool = True) -> dict[str, Column]:
    """The flags of a card, from its name, its texts and what was read off its pictures; without those of the languages on request."""
    where = parts(name, description, ocr)
    out = {flag: found(where[part], PATTERNS[p]) for flag, part, p in EVIDENCE if languages or flag not in LANGUAGE_FLAGS}
    if languages:
        out["ocr_mark_ru"] = out["ocr_mark_ru"] & ~found(ocr, PATTERNS["mark_ru_denied"])
    return out


def guess(category: Column, flag) -> Column:
    """What the rules alone say: 1 if the card fits its category. flag(name) gives a flag's column."""
    supplement = F.when(flag("explicit_not_supplement"), 0).when(flag("supplement_mark") | flag("supplement_mark_ocr"), 1).when(flag("sport_nutrition"), 0).otherwise(flag("supplement_word").cast("int"))
    other = F.when(flag("accessory") | flag("device_for_fire"), 0).otherwise((flag("ignition_source_name") | flag("fuel_content_name")).cast("int"))
    return F.when(category == SUPPLEMENT, supplement).otherwise(other)


def facts(name: Column, description: Column, category: Column, ocr: Column) -> Column:
    """array<string>: the phrases of the category's facts that hold, in order; then the text read, if there is some."""
    where = parts(name, description, ocr)
    read = F.trim(F.substring(F.regexp_replace(ocr, r"(?U)\s+", " "), 1, 160))
    marks = [F.when((category == c) & found(where[part], p), F.lit(phrase)) for c, rules in FACTS.items() for _, phrase, part, p in rules]
    return F.array_compact(F.array(*marks, F.when(F.length(read) > 15, F.concat(F.lit(READ_FACT), read))))


def facts_block(items: Column) -> Column:
    """Part of a prompt; nothing at all where there are no facts."""
    return F.when(F.size(items) > 0, F.concat(F.lit(FACTS_HEAD + "\n- "), F.array_join(items, "\n- "), F.lit("\n"))).otherwise("")


def fact_flags(name: Column, description: Column, category: Column) -> dict[str, Column]:
    """One flag for each fact; null for facts of another category."""
    where = parts(name, description, F.lit(""))
    return {f"{key}": F.when(category == c, found(where[part], p)) for c, rules in FACTS.items() for key, _, part, p in rules}


def product_type(text: Column) -> Column:
    """The first type whose pattern is found."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TYPES:
        out = out.when(found(text, pattern), F.lit(name))
    return out.otherwise("other")


def read_features(ocr: Column) -> dict[str, Column]:
    """Features of the text read off the pictures; zeros where there is none."""
    text = F.coalesce(ocr, F.lit(""))
    out = {k: found(text, p).cast("float") for k, p in READ_FLAGS.items()}
    return {**out, "ocr_len": F.log1p(F.length(text)).cast("float"), "ocr_n_frames": F.regexp_count(text, F.lit(r"\|")).cast("float")}


def explanation(name: Column, category: Column, verdict: Column, flag) -> Column:
    """Name, the first reason that holds for this category and verdict, and the conclusion."""
    plain = F.trim(name)
    head = F.substring(plain, 1, 70)
    short = F.when(F.length(plain) > 70, F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)).otherwise(plain)
    short = F.when(short == "", "Товар").otherwise(short)

    def said(key: tuple[bool, int]) -> Column:
        reasons, default, tail = REASONS[key]
        out = F.when(F.lit(False), F.lit(""))
        for name, phrase in reasons:
            out = out.when(flag(name), F.lit(phrase))
        return F.concat(out.otherwise(default), F.lit(". " + tail))

    supplement, fits = category == SUPPLEMENT, verdict == 1
    end = F.when(supplement & fits, said((True, 1))).when(supplement, said((True, 0))).when(fits, said((False, 1))).otherwise(said((False, 0)))
    return F.concat(F.lit("«"), short, F.lit("»: "), end)


def pyro_bonus(score: Column, name: Column, category: Column, bonus: float) -> Column:
    """Lift names of pyrotechnics, lower those that work by air; supplements stay."""
    text = F.lower(name)
    pyro, air = text.rlike("(?U)" + PYRO), text.rlike("(?U)" + AIR)
    lift = F.when(pyro & ~air, F.lit(bonus)).when(pyro & air, F.lit(-bonus)).otherwise(0.0)
    return score + F.when(category == SUPPLEMENT, 0.0).otherwise(lift)


# What generated comments are cleaned of.
LEAD, PREFIXES = "Решающее: ", r"^(?:запись|описание|обоснование|ответ|комментарий)\s*[:—-]\s*"
BANNED = r"\b(?:не\s+бан|бан|категори\w+|соответству\w+)\b"
LEAKED = ("supplement_mark_ocr", "supplement_mark", "supplement_word", "explicit_not_supplement", "sport_nutrition", "fuel_content_name", "fuel_content", "ignition_source_name", "in_kit", "device_for_fire", "accessory")
DANGLING = r"(?:\b(?:до|от|и|или|с|в|на|по|для|около|более|менее)|\d|/)\.$"
EMPTY_END = r"[,;]?\s*(?:но )?(?:не указано|не уточняется|отсутствует утверждение|информация отсутствует|а также)\s*\.?$"
# End of the fixed values.
STOPS = (". ", "! ", "? ")


def _last_stop(text: str, end: int, stops=STOPS) -> int:
    return max(text.rfind(s, 0, end) for s in stops)


def clean_generated(text: str | None, hit_cap: bool = False, least: int = 50, most: int = 300) -> str:
    """A generated comment without tags, leaked names, forbidden words and unfinished sentences. hit_cap: generation was cut off."""
    squeeze = lambda s: re.sub(r"\s+", " ", s)
    out = squeeze(re.sub("<[^>]*>", " ", text or "")).strip().strip('"“”«»').strip()
    out = re.sub(PREFIXES, "", out, flags=re.I)
    if out and not out.lower().startswith("решающее"):
        out = LEAD + out[0].lower() + out[1:]
    names = "|".join(LEAKED)
    if re.search(names, out):
        out = re.sub(rf"[^.!?]*(?:{names})[^.!?]*[.!?]?", " ", out)
    out = squeeze(re.sub(BANNED, "", out, flags=re.I)).strip(" ,;:-")
    if len(out) > most:
        at = _last_stop(out, most)
        out = (out[: at + 1] if at > least else out[:most].rsplit(" ", 1)[0]).strip()
    closed = lambda s: s == "" or s[-1] in ".!?"
    if not closed(out) and (at := _last_stop(out, len(out))) >= least:
        out = out[: at + 1].strip()
    if not closed(out):
        out += "."
    if hit_cap or re.search(DANGLING, out):
        at, comma = _last_stop(out, max(0, len(out) - 2), STOPS[:2]), out.rfind(", ")
        if at >= least:
            out = out[: at + 1].strip()
        elif comma >= least:
            out = out[:comma].rstrip(" ,;:-") + "."
    out = re.sub(EMPTY_END, ".", out, flags=re.I).strip()
    return re.sub(r"[\s,;:-]+\.$", ".", out)


def cleaned(text: Column, hit_cap: Column) -> Column:
    """clean_generated() by batches: its steps look back at what the ones before have left."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, caps: pd.Series) -> pd.Series:
        return pd.Series([clean_generated(t, bool(c)) for t, c in zip(texts, caps)])

    return run(text, hit_cap)
