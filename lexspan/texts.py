"""Words and messages that results must carry literally."""

# Kinds of standard.
KINDS = ["ФСБУ", "ПБУ"]

# Status of a standard on a date.
ACTIVE = "действует"
NOT_YET = "не вступил в силу"
REPEALED = "утратил силу"

# State of a standard's mapping.
MAPPING_NONE = "нет"
MAPPING_DRAFT = "черновик"
MAPPING_VERIFIED = "проверено"

# Kinds of relation between documents or clauses.
REPLACED = "заменён"
RELATION_KINDS = ["заменён", "аналог", "отсылка"]

# Kinds of configuration object.
OBJECT_KINDS = ["счёт", "регистр", "документ", "настройкаУП", "отчёт", "обработка", "справочник"]

# Suffix of the clause that closes a lettered list.
CONCLUSION = "заключение"

# Month names in the genitive, January first.
MONTHS = [
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
]

# Limits.
STALE_AFTER_DAYS = 90
MIN_CONFIDENCE = 60
MAX_SUMMARY_CHARS = 400
SNIPPET_CHARS = 300
MAX_HITS = 50
PREVIEW_PATHS = 20
PREVIEW_OFFENDERS = 10
SUGGESTIONS = 10
LEAST_HIT_RATE = 0.9
MIN_TOP_LEVEL_CLAUSES = 5
MAX_CLAUSE_CHARS = 4000
HEADING_MAX_WORDS = 6
ROMAN_TITLE_MAX_WORDS = 10

# BM25 constants of the full-text index.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# Domain abbreviations that are never lemmatised, and dropped particles.
PROTECTED_TERMS = ["фсбу", "пбу", "мсфо", "нма", "мпз", "ппа", "спи", "ос", "нку"]
STOP_LEMMAS = ["что", "ли"]

# Answer texts. Placeholders follow printf.
MSG_STANDARD_NOT_FOUND = "Стандарт '%s' отсутствует в корпусе"
MSG_NO_EDITION = "У стандарта '%s' нет редакции, действующей на %s"
MSG_CLAUSE_NOT_FOUND = "В стандарте '%s' нет пункта '%s'. Доступные пункты: %s"
MSG_BAD_DATE = "on_date должен быть датой в формате ГГГГ-ММ-ДД, получено '%s'"
MSG_ORDER_REF = "приказ Минфина России от %s № %s"
MSG_NOT_IN_FORCE = "На %s стандарт не действует: %s."
MSG_UNKNOWN_CONFIG = "Конфигурация '%s' серверу неизвестна."
MSG_KNOWN_CONFIGS = "Конфигурация '%s' серверу неизвестна. Известные конфигурации: %s."
MSG_NO_MAPPING = (
    "Проекция на конфигурацию 1С для этого стандарта пока не заполнена. "
    "Отсутствие записей не означает, что стандарт не реализован в конфигурации."
)
MSG_OBJECT_NOT_MAPPED = (
    "Объект известен в конфигурации, но ни один пункт стандартов ему пока не сопоставлен. "
    "Это может означать, что проекция для соответствующего стандарта пока не заполнена."
)
MSG_OBJECT_UNKNOWN = "Такой объект не найден в каталоге конфигурации."
MSG_OBJECT_SUGGESTED = (
    "Такой объект не найден в каталоге конфигурации. Возможно, вы имели в виду "
    "один из объектов ниже."
)
MSG_UNVERIFIED = (
    "Хотя бы одна из показанных строк не проверена человеком-экспертом и приведена как черновик. "
    "Не полагайтесь на нее без проверки по тексту пункта и по конфигурации."
)
MSG_NO_LINKS = "Ссылки на ИТС для этого стандарта пока не подобраны."
MSG_BAD_LIMIT = "limit должен быть положительным числом"
MSG_NO_HITS = (
    "По запросу ничего не найдено. Попробуйте переформулировать или снять фильтр по стандартам."
)
MSG_STALE = (
    "Корпус собран %s (%d дн. назад). Возможно, появились новые приказы Минфина. "
    "Требуется пересборка корпуса."
)
MSG_NO_ANNEX = (
    "В тексте не найдено приложение для стандарта '%s' (в документе найдены приложения для: %s)"
)

# Registry report.
REPORT_TITLE = "# Реестр стандартов бухгалтерского учета на %s"
REPORT_HEADER = [
    "| id | вид | номер | название | приказ | действует с | статус | проекция 1С |",
    "|---|---|---|---|---|---|---|---|",
]

# Snapshot diff report.
DIFF_ADDED = "### Новые стандарты в реестре Минфина"
DIFF_REMOVED = "### Стандарты исчезли из реестра"
DIFF_CHANGED = "### Изменились реквизиты"
DIFF_NONE = "Расхождений нет."
DIFF_FIELDS = {
    "order_no": "приказ",
    "effective_from": "применение с",
    "effective_to": "утрата силы",
}

# Where registry pages and published acts live.
REGISTRY_BASE_URL = "https://minfin.gov.ru"
ACTS_BASE_URL = "http://publication.pravo.gov.ru"

# Text of the approving order that must not leak into a clause.
ORDER_MARKERS = [
    "Утвердить прилагаемый",
    "Признать утратившими силу",
    "Установить, что",
    "Министр А.Г. Силуанов",
]
STAMP_MARKERS = ["Утвержден приказом", "УТВЕРЖДЕН", "УТВЕРЖДЁН", "УТВЕРЖДЕНЫ"]
