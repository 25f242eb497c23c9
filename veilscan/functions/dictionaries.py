"""Names, labels and lists that results must equal. Plain data in natural order."""

SEVERITY_RU = {"critical": "Критический", "high": "Высокий", "medium": "Средний", "low": "Низкий"}

PATTERN_RU = {
    "password": "Пароль", "api_key": "API-ключ", "token": "Токен", "private_key": "Приватный ключ", "aws_key": "AWS ключ", "github_token": "GitHub токен",
    "email": "Email", "phone_number": "Телефон", "ssn": "SSN", "credit_card": "Банковская карта", "json_secret": "JSON секрет", "env_var": "Переменная окружения",
    "connection_string": "Строка подключения", "bic": "BIC код", "iban": "IBAN", "yaml_secret": "YAML секрет", "hardcoded_secret": "Захардкоженный секрет", "passport": "Паспорт",
}

DESCRIPTION_RU = {
    "Password assignment detected": "Обнаружено присвоение пароля",
    "API Key detected": "Обнаружен API-ключ",
    "Authentication token detected": "Обнаружен токен аутентификации",
    "Private key detected": "Обнаружен приватный ключ",
    "AWS Access Key detected": "Обнаружен AWS ключ доступа",
    "GitHub token detected": "Обнаружен GitHub токен",
    "Email address detected": "Обнаружен email адрес",
    "Phone number detected": "Обнаружен номер телефона",
    "Social Security Number detected": "Обнаружен SSN",
    "Credit card number detected": "Обнаружен номер банковской карты",
    "JSON secret detected": "Обнаружен секрет в JSON",
    "YAML secret detected": "Обнаружен секрет в YAML",
    "Environment variable assignment detected": "Обнаружена переменная окружения",
    "Connection string detected": "Обнаружена строка подключения",
    "Hardcoded secret detected": "Обнаружен захардкоженный секрет",
    "IBAN detected": "Обнаружен IBAN",
    "BIC code detected": "Обнаружен BIC код",
    "Passport number detected": "Обнаружен номер паспорта",
}

SUGGESTION_RU = {
    "password": 'Используйте переменные окружения: os.Getenv("DB_PASSWORD")',
    "api_key": "Храните в .env файле: API_KEY=xxx, загружайте через godotenv",
    "private_key": "Переместите в ~/.ssh/ или используйте Vault для хранения",
    "aws_key": "Настройте AWS credentials через aws configure или IAM роли",
    "github_token": "Используйте GitHub App или Personal Access Token в секретах CI/CD",
    "credit_card": "НЕМЕДЛЕННО удалите! Данные карт не должны храниться в коде",
    "connection_string": "Используйте DATABASE_URL из переменных окружения",
    "token": "Храните токены в защищённом хранилище секретов",
}
SUGGESTION_DEFAULT = "Удалите чувствительные данные и используйте безопасное хранение"

CSV_HEADER = ["Путь к файлу", "Строка", "Начало колонки", "Конец колонки", "Тип паттерна", "Уровень серьёзности", "Оценка риска", "Энтропия", "Описание", "Найденный текст", "Контекст"]

IGNORED_DIRS = [".git", ".hg", ".svn", ".bzr", "node_modules", "vendor", ".cargo", "target", "build", "dist", "out", ".venv", "venv", ".env", "__pycache__", "coverage", ".coverage", ".tox"]
IGNORED_FILES = [".gitignore", ".env", ".env.local", "package-lock.json", "yarn.lock"]
IGNORED_EXTENSIONS = [".exe", ".dll", ".so", ".dylib", ".zip", ".tar", ".gz", ".rar", ".7z", ".jpg", ".png", ".gif", ".pdf", ".iso", ".mp3", ".mp4", ".avi", ".mov", ".log", ".bak", ".tmp", ".swp"]
DOCUMENT_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".odt", ".ods", ".odp"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp"]
ARCHIVE_EXTENSIONS = [".zip", ".tar", ".gz", ".tgz", ".rar", ".7z", ".bz2", ".xz"]
TEXT_EXTENSIONS = [".txt", ".json", ".yaml", ".yml", ".xml", ".csv", ".env", ".ini", ".cfg", ".conf", ".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".sh", ".bash", ".zsh", ".ps1", ".sql", ".md", ".rst", ".log"]
PRESETS = {"text": TEXT_EXTENSIONS, "documents": DOCUMENT_EXTENSIONS, "images": IMAGE_EXTENSIONS, "archives": ARCHIVE_EXTENSIONS}

#: Detectors of whole texts: name, label, RU risk label, threshold, then (confidence, where, RE2 pattern, indicator).
DOCUMENT_DETECTORS = [
    ("passport", "Паспорт", "critical", 0.3, [
        (0.3, "lower", r"(паспорт|passport|серия|номер паспорта|выдан|код подразделения|место рождения|дата рождения)", "Найдены ключевые слова паспорта"),
        (0.4, "text", r"\b\d{2}\s?\d{2}\s?\d{6}\b", "Найден номер паспорта (формат XX XX XXXXXX)"),
        (0.5, "text", r"[A-Z<]{2}[A-Z<]{3}[A-Z<]{39}", "Найдена машиночитаемая зона (MRZ)"),
        (0.2, "lower", r"(passport|passeport|reisepass|pasaporte)", "Найдены международные ключевые слова паспорта"),
    ]),
    ("driver_license", "Водительское удостоверение", "critical", 0.3, [
        (0.4, "lower", r"(водительское удостоверение|права|driver.?s?.?licen[sc]e|führerschein|permis de conduire)", "Найдены ключевые слова водительского удостоверения"),
        (0.3, "text", r"\b\d{2}\s?\d{2}\s?\d{6}\b", "Найден номер водительского удостоверения"),
    ]),
    ("id_card", "Удостоверение личности / СНИЛС / ИНН", "critical", 0.3, [
        (0.3, "lower", r"(удостоверение личности|identity card|id card|personalausweis|carte d'identité|снилс|инн)", "Найдены ключевые слова удостоверения личности"),
        (0.5, "text", r"\b\d{3}-\d{3}-\d{3}\s?\d{2}\b", "Найден СНИЛС (XXX-XXX-XXX XX)"),
        (0.4, "text", r"\b\d{12}\b", "Найден ИНН физического лица (12 цифр)"),
    ]),
    ("credit_card", "Банковская карта", "critical", 0.3, [
        (0.4, "lower", r"(visa|mastercard|american express|amex|mir|мир|maestro|valid thru|cvv|cvc|exp|срок действия)", "Найдены ключевые слова банковской карты"),
        (0.5, "text", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "Найден номер банковской карты"),
    ]),
    ("bank_statement", "Банковский документ", "high", 0.4, [
        (0.3, "lower", r"(bank statement|выписка|счёт|account|баланс|balance|transaction|операция|перевод|transfer)", "Найдены ключевые слова банковского документа"),
        (0.4, "text", r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}", "Найден IBAN"),
        (0.3, "text", r"[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?", "Найден BIC/SWIFT код"),
    ]),
    ("tax_document", "Налоговый документ", "high", 0.4, [
        (0.5, "lower", r"(налоговая|tax|ндфл|2-ндфл|3-ндфл|декларация|w-2|1099|tax return|справка о доходах)", "Найдены ключевые слова налогового документа"),
    ]),
    ("medical_record", "Медицинский документ", "critical", 0.4, [
        (0.4, "lower", r"(медицинская карта|medical record|health|диагноз|diagnosis|prescription|рецепт|анализ|полис омс|страховой полис)", "Найдены ключевые слова медицинского документа"),
        (0.4, "text", r"\b\d{16}\b", "Найден номер полиса ОМС"),
    ]),
]

#: Words of identity documents and what each adds to the keyword signal.
IMAGE_KEYWORDS = {
    "passport": 15, "паспорт": 15, "reisepass": 15, "passeport": 15, "mrz": 20, "machine readable": 15,
    "surname": 10, "фамилия": 10, "nom": 10, "nachname": 10, "given name": 10, "имя": 10, "prénom": 10, "vorname": 10, "nationality": 10, "гражданство": 10, "nationalité": 10,
    "date of birth": 10, "дата рождения": 10, "geburtsdatum": 10, "sex": 5, "пол": 5, "geschlecht": 5, "place of birth": 8, "место рождения": 8, "date of issue": 8, "дата выдачи": 8,
    "date of expiry": 8, "срок действия": 8, "valid until": 8, "authority": 6, "орган выдачи": 6, "signature": 6, "подпись": 6,
    "driver": 12, "водительское": 12, "führerschein": 12, "permis": 12, "license": 10, "удостоверение": 10, "licen": 10, "identity card": 12, "удостоверение личности": 12,
    "id card": 12, "id-karte": 12, "carte d'identité": 12, "visa": 12, "виза": 12, "residence permit": 12, "вид на жительство": 12, "work permit": 10, "разрешение на работу": 10,
    "код подразделения": 10, "снилс": 15, "инн": 12, "серия": 8, "номер": 6,
    "passpo": 10, "passp": 8, "aspor": 8, "surnam": 8, "urnam": 6, "birth": 8, "irth": 5, "expir": 8, "xpir": 5, "nation": 8, "ation": 5, "given": 8, "iven": 5,
    "russia": 10, "ussia": 8, "росси": 10, "holder": 8, "older": 5, "issuing": 8, "ssuing": 5,
    "pass0rt": 10, "passp0rt": 10, "passpcrt": 10, "b1rth": 6, "d0b": 6, "кем выдан": 8, "действителен": 6,
    "personal": 5, "персональные": 5, "confidential": 5, "конфиденциально": 5, "photo": 4, "фото": 4,
}
DOCUMENT_RATIOS = [("passport_page", 0.70), ("passport_closed", 1.42), ("passport_card", 1.37), ("id_card", 1.58), ("a4_portrait", 0.71)]
PHOTO_RATIOS = [0.78, 0.75]
SIGNAL_WEIGHTS = {"mrz": 0.35, "keywords": 0.20, "barcode": 0.12, "face": 0.10, "geometry": 0.08, "structure": 0.10, "quality": 0.05}
WEIGHTS_WITHOUT_MRZ = {"mrz": 0.0, "keywords": 0.35, "barcode": 0.12, "face": 0.10, "geometry": 0.18, "structure": 0.20, "quality": 0.05}
IMAGE_TYPE_RU = {
    "passport": "Паспорт", "passport_page": "Паспорт", "passport_closed": "Паспорт", "passport_card": "Паспорт", "passport_photo": "Фото на документы", "id_card": "Удостоверение личности",
    "driver_license": "Водительское удостоверение", "visa": "Виза", "residence": "Вид на жительство", "work_permit": "Разрешение на работу", "snils": "СНИЛС", "inn": "ИНН", "a4_portrait": "Документ", "unknown_document": "Документ",
}
IMAGE_TYPE_DEFAULT = "Документ"
MRZ_SHAPES = [r"P[A-Z<][A-Z<]{3}[A-Z<]{39}", r"[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{7}[MF<][0-9]{7}[A-Z0-9<]{14}[0-9]", r"[IACT][A-Z<][A-Z<]{3}[A-Z0-9<]{25}", r"[0-9]{7}[MF<][0-9]{7}[A-Z<]{3}[A-Z0-9<]{11}[0-9]", r"[A-Z0-9<]{30,44}"]
IMAGE_MRZ_SHAPES = [r"[A-Z][A-Z<][A-Z<]{3}[A-Z0-9<]{25}", r"[0-9]{6}[0-9<][MFX<][0-9]{6}[0-9<][A-Z<]{3}[A-Z0-9<]{11}[0-9<]", r"[A-Z][A-Z<][A-Z<]{3}[A-Z<]{31}", r"P[A-Z<][A-Z<]{3}[A-Z<]{39}", r"[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{6}[0-9][MFX<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9<][0-9]", r"[A-Z<]{2}[A-Z<]{3}[A-Z<]{30,42}", r"[A-Z0-9<]{30,44}"]
DATE_SHAPES = [r"\d{2}[./\-]\d{2}[./\-]\d{4}", r"\d{4}[./\-]\d{2}[./\-]\d{2}", r"\d{2}\s+\w+\s+\d{4}", r"\d{6}"]
RISK_LEVELS = [("critical", "🔴 КРИТИЧЕСКИЙ"), ("high", "🟠 ВЫСОКИЙ"), ("medium", "🟡 СРЕДНИЙ"), ("moderate", "🟡 УМЕРЕННЫЙ"), ("low", "🟢 НИЗКИЙ")]
RECOMMENDATIONS = {
    "critical": "🔴 Немедленно удалите или замаскируйте все критические секреты из кода",
    "private_key": "🔑 Переместите приватные ключи в защищённое хранилище (HashiCorp Vault, AWS Secrets Manager)",
    "password": "🔐 Используйте переменные окружения или менеджер секретов вместо хардкода паролей",
    "api_key": "🗝️ Ротируйте все обнаруженные API-ключи и настройте их безопасное хранение",
    "credit_card": "💳 СРОЧНО: Удалите данные банковских карт из кодовой базы. Это нарушение PCI DSS!",
    "connection_string": "🔗 Вынесите строки подключения к БД в конфигурацию окружения",
    "any": ["📋 Добавьте pre-commit хук для автоматической проверки секретов", "🛡️ Настройте .gitignore для исключения файлов с секретами", "📝 Обновите .env.example с примерами переменных (без реальных значений)"],
    "again": "🔄 После исправлений выполните повторное сканирование для проверки",
}

IMAGE_WARNINGS = {
    "leak": "⚠️ Высокий риск утечки персональных данных",
    "identity": "⚠️ Документ содержит идентифицирующую информацию",
    "passport": "⚠️ Паспортные данные могут быть использованы для мошенничества",
}
IMAGE_DATA = {
    "passport": ["📋 ФИО владельца", "📅 Дата рождения", "🔢 Номер документа", "📸 Фотография"],
    "card": ["📋 Персональные данные", "📸 Фотография", "🔢 Номер документа"],
    "other": ["📋 Персональные данные"],
}

# Words of the console and of the window, sizes, and descriptions of documents.
CONSOLE_SEVERITY_RU = {"critical": "Крит.", "high": "Высок.", "medium": "Сред.", "low": "Низк."}
WINDOW_SEVERITY_RU = {"critical": "Критич.", "high": "Высокий", "medium": "Средний", "low": "Низкий"}
WINDOW_PATTERN_RU = {
    "password": "Пароль", "api_key": "API-ключ", "token": "Токен", "private_key": "Приватный ключ", "aws_key": "AWS ключ", "github_token": "GitHub токен", "email": "Email", "phone_number": "Телефон", "ssn": "SSN",
    "credit_card": "Банк. карта", "json_secret": "JSON секрет", "env_var": "Перем. окружения", "connection_string": "Строка подключ.",
}
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
SIZE_UNITS_RU = ["Б", "КБ", "МБ", "ГБ", "ТБ"]
DOCUMENT_DESCRIPTION_RU = {
    "passport_page": "Обнаружена страница паспорта с персональными данными владельца.", "passport_closed": "Обнаружен паспорт (разворот). Виден документ целиком.", "passport_card": "Обнаружена карточка паспорта с фото и данными.",
    "id_card": "Обнаружено удостоверение личности с персональной информацией.", "driver_license": "Обнаружено водительское удостоверение.", "passport": "Обнаружен паспорт с персональными данными.",
}
DOCUMENT_DESCRIPTION_DEFAULT = "Обнаружен документ, содержащий персональные данные."
DETECTOR_TYPE_RU = {
    "passport": "Паспорт (внутренний или заграничный)", "driver_license": "Водительское удостоверение", "id_card": "Удостоверение личности / ID-карта", "credit_card": "Банковская карта",
    "bank_statement": "Банковская выписка / документ", "tax_document": "Налоговый документ (2-НДФЛ, декларация)", "medical_record": "Медицинская документация", "unknown": "Неизвестный тип документа",
}
FOUND_IN_IMAGE, FOUND_IN_PDF, ZONE_LABEL = " обнаружен", " обнаружен в PDF", "Паспорт с MRZ"
IMAGE_CONTEXT, PDF_CONTEXT = "Изображение документа (confidence: %s)", "PDF страница %d (confidence: %s)"
