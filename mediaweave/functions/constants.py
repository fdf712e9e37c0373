"""Values that results depend on."""

# The classes of the zero-shot classifier, in the order that breaks ties, and those that are technical.
CLASSES = (
    "screenshot", "receipt", "document", "carsharing", "meme", "screen_photo", "qr_code", "reference",
    "portrait", "selfie", "group_photo", "nature", "architecture", "monument", "museum", "food", "animals", "transport", "interior", "sports", "event", "book",
)
TECHNICAL = CLASSES[:8]

# Photo file extensions.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif", ".bmp", ".webp", ".raw", ".cr2", ".nef", ".arw", ".dng")

# Query terms and their translations.
TERMS = {
    "портреты": "portrait", "портрет": "portrait", "селфи": "selfie", "групповые": "group photo", "групповое фото": "group photo",
    "природа": "nature", "архитектура": "architecture", "памятники": "monument", "памятник": "monument", "музеи": "museum", "музей": "museum",
    "еда": "food", "животные": "animals", "животное": "animal", "транспорт": "transport", "интерьеры": "interior", "интерьер": "interior",
    "спорт": "sports", "мероприятия": "event", "мероприятие": "event", "книги": "book", "книга": "book",
    "скриншоты": "screenshot", "скриншот": "screenshot", "чеки": "receipt", "чек": "receipt", "документы": "document", "документ": "document",
    "каршеринг": "carsharing", "мемы": "meme", "мем": "meme", "фото экрана": "screen photo", "справочные": "reference", "qr": "qr_code", "штрихкод": "qr_code",
    "кот": "cat", "кошка": "cat", "котик": "cat", "собака": "dog", "пёс": "dog", "пляж": "beach", "море": "sea", "океан": "ocean",
    "горы": "mountains", "гора": "mountain", "закат": "sunset", "рассвет": "sunrise", "цветы": "flowers", "цветок": "flower", "лес": "forest", "дерево": "tree",
    "небо": "sky", "облака": "clouds", "снег": "snow", "зима": "winter", "лето": "summer", "дети": "children", "ребёнок": "child", "ребенок": "child",
    "свадьба": "wedding", "машина": "car", "люди": "people", "человек": "person", "город": "city", "улица": "street", "парк": "park", "река": "river", "озеро": "lake",
}

# Columns that a page may be sorted by, and those that an update may set.
SORTABLE = frozenset(
    "id exif_date original_filename file_size quality_blur quality_exposure quality_aesthetic processing_level content_category user_decision "
    "rank_in_cluster location_city location_country exif_gps_lat exif_gps_lon cluster_id is_exact_duplicate sync_status content_hash exif_camera".split()
)
UPDATABLE = {
    "sources": frozenset("status last_scanned_at photo_count name path".split()),
    "photos": frozenset(
        "processing_level cluster_id rank_in_cluster quality_aesthetic quality_blur quality_exposure content_category is_technical face_count perceptual_hash "
        "exif_date exif_gps_lat exif_gps_lon exif_camera exif_orientation exif_width exif_height location_country location_city location_district clip_embedding "
        "user_decision user_cluster_override sync_status is_exact_duplicate current_path source_id".split()
    ),
    "clusters": frozenset("name best_photo_id photo_count type avg_timestamp avg_gps_lat avg_gps_lon location_city".split()),
    "persons": frozenset("name hidden".split()),
}

# Limits of the reference behaviour.
TIME_WINDOW_S, GPS_RADIUS_M = 180, 50.0
HAMMING = {"AB": 12, "GPS": 6, "DATE": 12, "NONE": 4}
MERGE_SIMILARITY, FACE_SIMILARITY, FACE_NEIGHBOURS = 0.90, 0.5, 20
SEARCH_THRESHOLD, SEARCH_PENALTY, SEARCH_LIMIT, QUERY_LENGTH = 0.18, 0.10, 200, 256
DEFAULT_SECONDS = {"cuda": 0.020, "mps": 0.055, "cpu": 0.200}
EARTH_M = 6_371_000.0
