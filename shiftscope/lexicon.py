"""Lexicons, lookup tables and patterns.

Everything between the FIXED VALUES markers below is data whose exact
content decides results (schedule tables, marker patterns, keyword
lists, currency codes).  It is stated once here, as plain text, and the
jobs build Spark expressions or small dimension DataFrames from it.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the behaviour being reproduced) — begin
# ---------------------------------------------------------------------------

# Schedule dimension: (schedule, shifts per month, default hours per shift).
# Three profiles exist; the hours column is None where a profile has no
# default for that schedule.
SCHEDULE_PROFILES: dict[str, list[tuple[str, float, float | None]]] = {
    # used when pricing an export row from its monthly salary
    "fetch": [
        ("5/2", 22.0, 8.0), ("2/2", 15.0, 12.0), ("3/3", 15.0, None),
        ("4/3", 17.0, None), ("4/4", 15.0, None), ("6/1", 26.0, None),
        ("1/3", 8.0, None), ("1/1", 15.0, None), ("7/0", 30.0, None),
    ],
    # used by the analytics metric fill (no 1/1)
    "metrics": [
        ("5/2", 22.0, 8.0), ("2/2", 15.0, 12.0), ("3/3", 15.0, None),
        ("4/3", 17.0, None), ("4/4", 15.0, None), ("6/1", 26.0, None),
        ("1/3", 8.0, None), ("7/0", 30.0, None),
    ],
    # used by the board-record normaliser (defaults for every schedule)
    "board": [
        ("5/2", 22.0, 8.0), ("2/2", 15.0, 12.0), ("3/3", 15.0, 12.0),
        ("4/3", 17.0, 12.0), ("4/4", 15.0, 12.0), ("6/1", 26.0, 8.0),
        ("1/3", 8.0, 12.0),
    ],
}
WEEKS_PER_MONTH = 4.33
FALLBACK_SHIFT_HOURS = 12.0

# Currency tokens -> ISO code (anything else: the token upper-cased).
CURRENCY_CODES: list[tuple[str, str]] = [
    ("₽", "RUB"), ("руб", "RUB"), ("руб.", "RUB"), ("rur", "RUB"), ("rub", "RUB"),
    ("$", "USD"), ("usd", "USD"),
    ("€", "EUR"), ("eur", "EUR"),
    ("uah", "UAH"), ("грн", "UAH"), ("₴", "UAH"),
    ("kzt", "KZT"), ("₸", "KZT"),
    ("byn", "BYN"), ("br", "BYN"),
    ("£", "GBP"), ("gbp", "GBP"),
]
CURRENCY_TOKEN_RE = r"₽|руб\.?|rur|rub|uah|грн|₴|€|eur|usd|\$|kzt|₸|byn|br|£|gbp"

# Currency words -> symbols, applied in this order (word-bounded).
CURRENCY_WORD_SYMBOLS: list[tuple[str, str]] = [
    ("руб\\.?", "₽"), ("rub", "₽"), ("rur", "₽"), ("грн", "₴"), ("uah", "₴"),
    ("usd", "$"), ("eur", "€"), ("kzt", "₸"), ("byn", "Br"), ("gbp", "£"), ("br", "Br"),
]

# Rate markers, searched in lower-cased, whitespace-squeezed text.
HOURLY_MARKERS: list[str] = [
    r"\bв\s*час\b",
    r"/\s*ч(?:ас)?\b",
    r"\bчасова[яе]\s*ставка\b",
    r"₽\s*/\s*ч",
    r"руб\.?\s*/\s*ч",
    r"\brur/hour\b",
    r"\brub/hour\b",
    r"\brub/hr\b",
    r"\buah/hour\b",
    r"\beur/hour\b",
    r"\busd/hour\b",
    r"\$\s*/\s*hour",
    r"\$\s*/\s*hr",
    r"\bper[-\s]?hour\b",
    r"\bhourly\b",
]
SHIFT_MARKERS: list[str] = [
    r"\bза\s*смену\b",
    r"/\s*смен",
    r"₽\s*/\s*смен",
    r"руб\.?\s*/\s*смен",
    r"\bсменн\w*\s*ставка\b",
    r"\bсмена\b[^.,;\n\r]{0,12}[–—-]",
    r"\bper[-\s]?shift\b",
    r"\bshift\s*pay\b",
]

# Gross / net salary markers (negative markers win).
GROSS_POSITIVE: list[str] = [
    r"до\s*вычета(?:\s*налога)?",
    r"до\s*вычета\s*ндфл",
    r"до\s*удержания(?:\s*ндфл)?",
    r"до\s*уплаты\s*налогов",
    r"\bgross\b",
    r"\bбрутто\b",
]
GROSS_NEGATIVE: list[str] = [
    r"на\s*руки",
    r"после\s*вычета",
    r"\bnet\b",
    r"\bчистыми\b",
]
GROSS_COLLAPSED_MARKERS: list[str] = [
    "довычета", "довычетаналога", "додержания", "додержанияндфл", "доуплатыналогов",
]
GROSS_NOTE = "До вычета налога"

# Schedule words ("два через два").
SCHEDULE_NUMBER_WORDS: list[tuple[str, int]] = [
    ("сутки", 1), ("день", 1), ("один", 1), ("одна", 1), ("двое", 2), ("два", 2),
    ("две", 2), ("трое", 3), ("три", 3), ("четверо", 4), ("четыре", 4),
    ("пять", 5), ("шесть", 6), ("семь", 7),
]
# Whole-phrase schedules, in this order.
SCHEDULE_PHRASES: list[tuple[str, str]] = [
    ("пятидневк", "5/2"),
    (r"пятидневн\w*\s+рабоч\w*\s+недел", "5/2"),
    (r"день\s+через\s+день", "1/1"),
    (r"сутки\s+через\s+тро[её]", "1/3"),
    (r"сутки\s*[/\\]\s*тро[её]", "1/3"),
]

# Role filters by title: include / exclude patterns per role.
ROLE_FILTERS: dict[str, dict[str, list[str]]] = {
    "повар": {
        "inc": [r"\bповар\b", r"\bшеф-?повар\b", r"\bсу-?шеф\b",
                r"\bпиццамейкер\b", r"\bсушист\b", r"\bкондитер\b", r"\bпекар\b"],
        "exc": [r"\bаттракци", r"\bкол-?центр\b", r"\bcall[- ]?центр\b",
                r"\bпродаж", r"\bкассир\b", r"\bстанк", r"\bазс\b", r"\bзаправк"],
    },
    "повар_холодного_цеха": {
        "inc": [r"\bповар\b.*\bхолодн\w*\b", r"\bповар холодного цеха\b", r"\bхолодный цех\b"],
        "exc": [r"\bаттракци", r"\bкассир\b", r"\bстанк", r"\bcall[- ]?центр\b",
                r"\bофициант\b", r"\bбармен\b"],
    },
    "повар_горячего_цеха": {
        "inc": [r"\bповар\b.*\bгоряч\w*\b", r"\bповар горячего цеха\b", r"\bгорячий цех\b"],
        "exc": [r"\bаттракци", r"\bкассир\b", r"\bстанк", r"\bcall[- ]?центр\b",
                r"\bофициант\b", r"\bбармен\b"],
    },
    "оператор_доставки": {
        "inc": [r"\bоператор\W{0,3}достав", r"\bоператор заказов\b",
                r"\bдиспетчер[- ]?достав", r"\bкоординатор достав",
                r"\bоператор (?:пвз|пункта выдачи)\b", r"\bпункт выдачи\b",
                r"\bсборщик заказов\b"],
        "exc": [r"\bаттракци", r"\bкассир\b", r"\bпродаж", r"\bстанк",
                r"\bcall[- ]?центр\b", r"\bофициант\b", r"\bбармен\b"],
    },
    "кассир": {
        "inc": [r"\bкассир\b", r"\bстарший\s+кассир\b",
                r"\bкассир[- ]операционист\b", r"\bпродавец[- ]кассир\b",
                r"\bкассир[- ]консультант\b", r"\bкассир[- ]смены\b"],
        "exc": [r"\bбариста\b", r"\bадминистратор\b", r"\bбухгалтер\w*\b",
                r"\bоператор\b", r"\bcall[- ]?центр\b",
                r"\bофициант\b", r"\bбармен\b", r"\bповар\b",
                r"^(?=.*продавец[- ]?консультант)(?!.*кассир).*$"],
    },
    "менеджер_разработки_продукта": {
        "inc": [r"\bменеджер\b.*\bразработк\w*\b.*\bпродукт",
                r"\bменеджер\b.*\bразработк\w*\b.*\bменю\b",
                r"\bменеджер\b.*\bблюд\w*\b", r"\bпродукта\b",
                r"\bменеджер\s*r\W?&\W?d\b",
                r"\bproduct\s*development\b"],
        "exc": [r"\bproduct\s*manager\b",
                r"\bIT\b|\bайти\b|\bdigital\b|\bsoftware\b|\bприложен|\bПО\b"],
    },
    "бариста": {
        "inc": [r"\bбариста\b", r"\bстарший\s+бариста\b", r"\bbarista\b",
                r"\bкофе[йи]\w*\s*мастер\b"],
        "exc": [r"\bофициант\b", r"\bповар\b", r"\bбармен\b", r"\bкассир\b",
                r"\bадминистратор\b", r"\bоператор\b", r"\bcall[- ]?центр\b",
                r"\bпромоутер\b", r"\bкурьер\b", r"\bпродаж", r"\bаттракци"],
    },
    "smm_менеджер": {
        "inc": [r"\bsmm\b", r"\bsmm[- ]?менеджер\b", r"\bsmm[- ]?manager\b",
                r"\bспециалист\s+по\s+smm\b", r"\bsmm[- ]?специалист\b",
                r"\bsmm[- ]?маркетолог\b"],
        "exc": [r"\bcall[- ]?центр\b", r"\bоператор\b", r"\bпродаж", r"\bsales\b",
                r"\bseo\b", r"\bppc\b", r"\bконтекст\b", r"\bтаргетолог\b",
                r"\bкопирайтер\b", r"\bдизайнер\b", r"\bmotion\b", r"\bвидеограф\b",
                r"\bpr\b|\bpublic\s*relations\b", r"\bаккаунт[- ]?менеджер\b",
                r"\bадминистратор\b", r"\bофициант\b", r"\bкурьер\b"],
    },
}

# Benefit keywords, matched as substrings in this order ("дмс" shown upper-cased).
BENEFIT_KEYWORDS: list[str] = [
    "дмс", "медицинская страховка", "страхование", "питание", "бесплатное питание",
    "корпоративное питание", "форма", "униформа", "спецодежда", "премии", "бонус",
    "бонусы", "подарки", "скидки", "обучение", "проезд", "оплата проезда", "жилье",
    "жильё", "общежитие", "развозка", "транспорт", "кофе", "чай",
]

# Pay frequency, employment and work-format rules: (priority, pattern, label).
PAY_FREQUENCY_RULES: list[tuple[str, str]] = [
    ("еженедел|каждую неделю|раз в неделю|weekly", "Еженедельно"),
    ("2 раза в месяц|два раза в месяц|аванс", "2 раза в месяц"),
    ("ежемесяч|раз в месяц|monthly", "Ежемесячно"),
]
EMPLOYMENT_TEXT_RULES: list[tuple[str, str]] = [
    ("гпх|гражданско-правов|самозанят|подряд|аутстаф", "ГПХ"),
    ("по тк|трудов|официальн|оформление по тк|белая зп", "ТК"),
]
EMPLOYMENT_NAME_RULE = ("полная|частичная|полный|частичный", "ТК")
WORK_FORMAT_RULES: list[tuple[list[str], str]] = [
    (["удал", "home office", "remote"], "удаленно"),
    (["гибрид", "частично удал"], "гибрид"),
    (["вахт"], "вахта"),
    (["разъезд"], "разъездная"),
    (["офис", "на территории", "в офисе"], "офис"),
]

# Duties section headings.
DUTY_HEADINGS: list[str] = ["обязанности", "что делать", "чем предстоит заниматься", "задачи"]
DUTY_NEXT_HEADINGS: list[str] = [
    "требования", "условия", "мы предлагаем", "о компании", "график", "контакты",
    "оформление", "что мы предлагаем",
]

# Shift-length context scoring words.
SHIFT_GOOD_WORDS: list[str] = ["смен", "граф", "рабоч", "сут", "смена", "день"]
SHIFT_BAD_WORDS: list[str] = ["перерыв", "обед", "пауз", "минут"]
SHIFT_TAIL_STOP: list[str] = ["лет", "год", "месяц", "недел"]

# Working-hours triggers and day names.
WORK_SECTION_HINTS: list[str] = [
    "часы работы", "режим работы", "режим", "график", "графік", "schedule",
    "opening hours", "working hours", "shift", "смен", "вахт", "сутк",
]
FLEXIBLE_RE = r"(гибк\w*\s+график|по\s+согласованию|по\s+договоренности|flexible\s+(?:schedule|hours))"
IS247_RE = r"(24\s*[/x]\s*7|круглосуточ|без\s+выходных|around\s+the\s+clock|цілодоб)"
CLOSED_RE = r"(выходн|нерабоч|closed|off)"
DAY_ORDER: list[str] = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
DAY_TOKENS: list[tuple[str, str]] = [
    ("пн", "Mon"), ("понедельник", "Mon"), ("понеділок", "Mon"), ("mon", "Mon"), ("monday", "Mon"),
    ("вт", "Tue"), ("вторник", "Tue"), ("вівторок", "Tue"), ("tue", "Tue"), ("tues", "Tue"),
    ("tuesday", "Tue"),
    ("ср", "Wed"), ("среда", "Wed"), ("середа", "Wed"), ("wed", "Wed"), ("wednesday", "Wed"),
    ("чт", "Thu"), ("четверг", "Thu"), ("четвер", "Thu"), ("thu", "Thu"), ("thur", "Thu"),
    ("thurs", "Thu"), ("thursday", "Thu"),
    ("пт", "Fri"), ("пятница", "Fri"), ("п'ятниця", "Fri"), ("fri", "Fri"), ("friday", "Fri"),
    ("сб", "Sat"), ("суббота", "Sat"), ("субота", "Sat"), ("sat", "Sat"), ("saturday", "Sat"),
    ("вс", "Sun"), ("воскресенье", "Sun"), ("неделя", "Sun"), ("неділя", "Sun"), ("нд", "Sun"),
    ("sun", "Sun"), ("sunday", "Sun"),
]

# Experience buckets of the board normaliser.
EXPERIENCE_NONE_LABEL = "без опыта"

# Section headings by kind, and where pages state their schedule: block names
# in this order, then words of a label.
SECTION_WORDS: list[tuple[str, list[str]]] = [
    ("duties", ["обязанности", "что делать", "задачи"]),
    ("requirements", ["требования", "кандидат"]),
    ("conditions", ["условия", "мы предлагаем", "что предлагаем"]),
]
SCHEDULE_BLOCKS: list[str] = [
    "vacancy-view-employment-mode", "vacancy-view-raw__schedule", "vacancy-view-raw__workingschedule",
    "vacancy-view-employment-type", "vacancy-view-raw__main-info", "vacancy-view-employment-mode-item",
]
SCHEDULE_LABELS: list[str] = ["график", "рабочие часы", "смена"]

# Month names by stem, and range units in days (both matched at the start of a word).
MONTH_STEMS: list[tuple[str, int]] = [
    ("янв", 1), ("фев", 2), ("мар", 3), ("апр", 4), ("ма[йя]", 5), ("июн", 6),
    ("июл", 7), ("авг", 8), ("сен", 9), ("окт", 10), ("ноя", 11), ("дек", 12),
]
RANGE_UNIT_DAYS: list[tuple[str, float]] = [
    ("час", 1 / 24), ("hour", 1 / 24), ("нед", 7.0), ("week", 7.0), ("мес", 30.0), ("month", 30.0),
    ("год", 365.0), ("лет", 365.0), ("year", 365.0),
]

# City slugs of the listing board.
CITY_SLUGS: list[tuple[str, str]] = [
    ("москва", "moskva"), ("санкт-петербург", "sanktpeterburg"),
    ("санкт петербург", "sanktpeterburg"), ("спб", "sanktpeterburg"),
    ("екатеринбург", "ekaterinburg"), ("новосибирск", "novosibirsk"), ("казань", "kazan"),
    ("нижний новгород", "nizhnijnovgorod"), ("самара", "samara"), ("омск", "omsk"),
    ("ростов-на-дону", "rostovnadonu"), ("уфа", "ufa"), ("красноярск", "krasnojarsk"),
    ("пермь", "perm"), ("воронеж", "voronezh"), ("волгоград", "volgograd"),
]

# Regions of the board's paths.
REGION_SLUGS: list[tuple[str, str]] = [
    ("москва", "moskva"), ("moscow", "moskva"), ("санкт-петербург", "sankt-peterburg"),
    ("санкт петербург", "sankt-peterburg"), ("спб", "sankt-peterburg"), ("ekaterinburg", "ekaterinburg"),
    ("екатеринбург", "ekaterinburg"), ("новосибирск", "novosibirsk"), ("казань", "kazan"),
    ("нижний новгород", "nizhniy_novgorod"), ("самара", "samara"), ("ростов-на-дону", "rostov-na-donu"),
    ("ростов на дону", "rostov-na-donu"), ("уфа", "ufa"), ("красноярск", "krasnoyarsk"),
    ("пермь", "perm"), ("воронеж", "voronezh"), ("волгоград", "volgograd"),
]

# Cities of the listing paths.
LISTING_CITIES: list[tuple[str, str]] = [
    ("москва", "moskva"), ("moscow", "moskva"), ("санкт-петербург", "sankt-peterburg"), ("spb", "sankt-peterburg"),
    ("казань", "kazan"), ("новосибирск", "novosibirsk"),
]

# Display defaults.
UNKNOWN_LABEL = "(не указано)"
NO_COMPANY = "Не указано"
NO_TITLE = "Вакансия"

# Transliteration of Russian letters for slugs: multi-letter first, then 1:1.
TRANSLIT_MULTI: list[tuple[str, str]] = [
    ("ж", "zh"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"),
]
TRANSLIT_SINGLE_FROM = "абвгдеёзийклмнопрстуфхцыэ"
TRANSLIT_SINGLE_TO = "abvgdeeziyklmnoprstufhcye"
TRANSLIT_DROP = "ъь"

# Job-link allow list: the own board host passes only with a job token;
# partner boards always pass.
LINK_OWN_HOST = "gorodrabot.ru/"
LINK_JOB_TOKENS: list[str] = ["vacancy", "вакан", "%d0%b2%d0%b0%d0%ba", "/rabota", "/search", "/vacancies"]
LINK_PARTNER_HOSTS: list[str] = ["hh.ru", "superjob.ru", "rabota.ru", "zarplata.ru", "trudvsem.ru"]

# Board item URL (matched on the lower-cased, trimmed URL).
ITEM_URL_RE = r"^https?://(?:www\.)?avito\.ru/.*/vakansii/[^/?#]+-\d{6,}(?:[/?#].*)?$"
EXTERNAL_ID_RE = r"-(\d{6,})"

# Control characters removed before export.
CONTROL_CHARS_RE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"

# Plausible pay bounds of the report.
HOURLY_BOUNDS = (50.0, 100000.0)
MONTHLY_K_BOUNDS = (10.0, 10000.0)

# ---------------------------------------------------------------------------
# FIXED VALUES — end
# ---------------------------------------------------------------------------
