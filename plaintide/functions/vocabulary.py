"""Word lists, category keys and text formats.

They are part of what the results mean, so they are stated here as they are
and every function that uses one takes it as a parameter.
"""

# Words that make a review severe.
SEVERE_WORDS = [
    "환불", "사기", "고장", "불량", "파손", "위험", "가짜",
    "거짓", "망가", "부러", "깨진", "찢어", "곰팡이",
]

# Words of medium weight.
MEDIUM_WORDS = [
    "실망", "늦", "지연", "다름", "불만", "교환",
    "냄새", "얼룩", "흠집", "빠짐", "누락", "안 옴",
    "안옴", "오배송", "반품",
]

# The ten keys of hand labels and training sets.
LABEL_KEYS = [
    "delivery_delay", "wrong_item", "poor_quality", "damaged_packaging", "size_issue",
    "missing_parts", "not_as_described", "customer_service", "price_issue", "other",
]

# Category key -> display label.
DISPLAY_LABELS = {
    "battery_issue": "배터리 문제",
    "network_issue": "네트워크 문제",
    "display_issue": "화면 문제",
    "software_issue": "소프트웨어 문제",
    "overheating": "발열",
    "sound_issue": "사운드 문제",
    "delivery_delay": "배송 지연",
    "wrong_item": "오배송",
    "poor_quality": "품질 불량",
    "damaged_packaging": "포장 파손",
    "size_issue": "크기 불만",
    "missing_parts": "구성품 누락",
    "not_as_described": "상품 불일치",
    "customer_service": "고객 서비스",
    "price_issue": "가격 불만",
    "positive_review": "긍정 리뷰",
    "other": "기타",
}

# Words left out of keyword mining.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare",
    "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through",
    "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "and", "but",
    "if", "or", "because", "until", "while", "this", "that", "these", "those", "am", "it", "its", "i", "me",
    "my", "myself", "we", "our", "you", "your", "he", "him", "his", "she", "her", "they", "them", "what",
    "which", "who", "whom", "also", "get", "got", "like", "even",
]

# Lines of a captured page that are not review text.
PAGE_SKIP_WORDS = ["작성", "구매", "옵션", "판매자", "신고"]
PAGE_RATING_PATTERNS = [r"별점\s*(\d)", r"(\d)점"]
PAGE_SCRIPT_PATTERN = r"[가-힣]"

# Host substring -> platform, first match wins.
PLATFORM_HOSTS = [("coupang", "coupang"), ("naver", "naver"), ("smartstore", "naver")]
PRODUCT_ID_PATTERN = r"/products/(\d+)"

# Cell texts a CSV reader of the pandas kind takes as missing.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The system text of a chat training example.
CHAT_SYSTEM_TEXT = """You are an expert at analyzing e-commerce customer reviews and categorizing their primary complaints.

Categories:
- delivery_delay: Shipping or delivery issues
- wrong_item: Received incorrect product
- poor_quality: Product quality problems
- damaged_packaging: Damaged package or product
- size_issue: Size-related issues
- missing_parts: Missing parts or accessories
- not_as_described: Product doesn't match description
- customer_service: Customer service issues
- price_issue: Price-related complaints
- other: Cannot be categorized

Respond with ONLY the category name, nothing else."""
CHAT_USER_PREFIX = "Categorize this review: "

# Words for labelling by rule, taken from the examples a labelling guide gives
# for each key. Dictionary order is the last tie-break.
RULE_WORDS = {
    "delivery_delay": ["늦", "배송이 너무 느", "걸렸", "late", "delayed", "slow delivery", "slow shipping"],
    "wrong_item": ["다른 색상", "주문한 게 아니", "오배송", "wrong item", "wrong color", "wrong product"],
    "poor_quality": ["품질", "싸구려", "고장", "망가", "cheap", "broke", "quality"],
    "damaged_packaging": ["찢어", "깨진", "파손", "damaged", "crushed"],
    "size_issue": ["사이즈", "작아요", "too small", "too big", "size"],
    "missing_parts": ["설명서가 없", "부속품", "빠졌", "누락", "missing"],
    "not_as_described": ["사진과 달", "기능이 없", "not as described", "different from"],
    "customer_service": ["환불 안", "연락이 안", "customer service", "no response"],
    "price_issue": ["비싸", "가성비", "expensive", "overpriced", "price"],
}
