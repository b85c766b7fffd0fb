"""Fixed values that results depend on: word lists, labels and message texts."""

from __future__ import annotations

# Residential words and ledger words.
APARTMENT = "아파트"
MIXED_USE = "주상복합"
LEASE_PURE = "전세"
OWNERSHIP = "소유권"
KIND_UNKNOWN = "미상"
RENTAL, FOR_SALE, MIXED_TENURE = "임대", "분양", "혼합"
LEDGER_USE, LEDGER_DETAIL = "공동주택", "아파트"

# Price windows in months and the weight of a trade by month distance, in twentieths
# (1, .8, .65, .5, up to six months .3, otherwise .15).
WINDOWS = (0, 1, 2, 3, 6, 12)
WEIGHT_TWENTIETHS = ((0, 20), (1, 16), (2, 13), (3, 10), (6, 6))
WEIGHT_FAR_TWENTIETHS = 3

# Area bands in square metres, by type.
ANALYSIS_BANDS = {59: (57.0, 61.5), 84: (82.0, 86.5)}
INGEST_SMALL_BAND = (45.0, 75.0)

# Text tokens and the line each one stands for.
LINE_TOKENS = (
    ("신분당", "신분당"), ("Shinbundang", "신분당"),
    ("수인", "수인분당"), ("Suin", "수인분당"), ("분당", "수인분당"), ("Bundang", "수인분당"),
    ("경의", "경의중앙"), ("중앙선", "경의중앙"), ("Gyeongui", "경의중앙"),
    ("공항철도", "공항"), ("AREX", "공항"), ("Airport Railroad", "공항"), ("Airport Railway", "공항"),
    ("경춘", "경춘"), ("Gyeongchun", "경춘"), ("서해", "서해"), ("Seo hae", "서해"),
    ("신림선", "신림"), ("Sillim Line", "신림"), ("우이신설", "우이신설"), ("Ui-Sinseol", "우이신설"),
    ("GTX-A", "GTX-A"), ("GTX A", "GTX-A"), ("SRT", "SRT"),
)

# Lines of a station by name.
STATION_LINES = {
    "당산": "2,9", "영등포구청": "2,5", "문래": "2", "영등포": "1", "신길": "1,5", "대림": "2,7",
    "도림천": "2", "양평": "5", "여의도": "5,9", "여의나루": "5", "샛강": "9,신림", "국회의사당": "9",
    "영등포시장": "5", "보라매": "7,신림", "신풍": "7", "신대방삼거리": "7", "대방": "1,신림",
    "왕십리": "2,5,경의중앙,수인분당", "서울숲": "수인분당", "성수": "2", "뚝섬": "2",
    "옥수": "3,경의중앙", "금호": "3", "신금호": "5", "행당": "5", "마장": "5", "상왕십리": "2",
    "응봉": "경의중앙", "한양대": "2", "용답": "2", "신답": "2",
    "공덕": "5,6,경의중앙,공항", "마포": "5", "대흥": "6", "광흥창": "6", "상수": "6", "합정": "2,6",
    "홍대입구": "2,경의중앙,공항", "애오개": "5", "아현": "2", "신촌": "2", "이대": "2",
    "서강대": "경의중앙", "망원": "6", "월드컵경기장": "6", "마포구청": "6",
    "디지털미디어시티": "6,경의중앙,공항", "가좌": "경의중앙",
    "노량진": "1,9", "노들": "9", "흑석": "9", "동작": "4,9", "상도": "7", "장승배기": "7",
    "숭실대입구": "7", "남성": "7", "이수": "4,7", "총신대입구": "4,7", "사당": "2,4", "신대방": "2",
}

# Price tier of a region as shown in the region table.
REGION_TIERS = {
    "강남구": 1, "서초구": 1, "용산구": 2, "송파구": 2, "성동구": 3, "마포구": 4, "광진구": 4,
    "동작구": 5, "양천구": 5, "강동구": 5, "영등포구": 6, "중구": 6, "종로구": 7, "서대문구": 7,
    "동대문구": 7, "성북구": 8, "강서구": 8, "관악구": 8, "구로구": 9, "노원구": 9, "은평구": 9,
    "중랑구": 9, "강북구": 9, "금천구": 9, "도봉구": 9,
    "과천시": 2, "분당시": 4, "광명시": 7, "하남시": 6, "평촌동": 8, "수지구": 7, "광교": 7,
    "동탄시": 8, "성남시": 6, "수정구": 6, "중원동": 8, "삼송동": 8, "지축": 8, "일산시": 9,
    "의왕시": 8, "구리시": 8,
}

# Reason texts of the confidence grade ({} = side label, number or area).
SIDE_LABEL = {"start": "과거", "end": "현재"}
REASON_NO_ESTIMATE = "10층 이상 실거래 표본이 부족해 정상 중층 매수가를 계산하지 못함"
REASON_AREA = "%s: 대표 전용 %s㎡ 사용"
REASON_AREA_FALLBACK = "%s: 대표 전용 %s㎡ 대신 %s㎡ 대체 사용"
REASON_FALLBACK = "%s: 동일 대표면적 표본 부족으로 근접 타입 대체"
REASON_EXACT = "%s: 목표월 10층 이상 거래 사용"
REASON_WINDOW = "%s: ±%d개월까지 확대"
REASON_SAMPLES = "%s: 정상거래 표본 %d건"
REASON_OUTLIERS = "%s: 주변 시세 흐름과 크게 벗어난 거래 %d건 제외"

# Outcome of the floor-area-ratio check.
FAR_NO_LEDGER = "단지와 일치하는 총괄표제부 없음"
FAR_NO_CANDIDATE = "대지·세대수 일치 대장 없음"
FAR_MANY = "동일 단지 대장이 여러 개: 확인 필요"
FAR_NO_VALUE = "공식 용적률 값 없음 또는 0"
FAR_RATIO = "대장 용적률과 산정면적 비율 불일치"
FAR_OK = "주소·세대수 일치 총괄표제부"

# Reasons for which a complex is held back.
HELD_CONFLICT = "동일 관리코드 기본정보 충돌"
HELD_APPROVAL = "사용승인일 확인 필요"
HELD_PARCELS = "여러 지번/세부 단지 합산 세대수: 각각 300세대 이상인지 확인 필요"

# Columns of the yearly lease archive.
ARCHIVE_FIELDS = {
    "접수년도": "rcpt_yr", "자치구코드": "cgg_cd", "법정동코드": "stdg_cd", "법정동명": "stdg_nm",
    "본번": "mno", "부번": "sno", "층": "flr", "계약일": "ctrt_day", "전월세구분": "rent_se",
    "임대면적": "rent_area", "보증금(만원)": "grfe", "임대료(만원)": "rtfe", "건물명": "bldg_nm",
    "건축년도": "arch_yr", "건물용도": "bldg_usg", "계약기간": "ctrt_prd", "신규계약구분": "new_updt_yn",
    "갱신청구권사용": "ctrt_updt_use_yn", "종전보증금": "bfr_grfe", "종전임대료": "bfr_rtfe",
}

# Text around the rows of a published part.
PART_PREFIX = "window.__EMBEDDED_DATA__.complexes.push(..."
PART_SUFFIX = ");window.__DATA_PART_COUNT__=(window.__DATA_PART_COUNT__||0)+1;\n"
PART_MAX_BYTES = 8 * 1024 * 1024

# Bounding boxes (lon min, lat min, lon max, lat max).
NETWORK_BOX = (126.65, 36.9, 127.4, 37.78)
COORDINATE_BOX = (126.6, 36.8, 127.5, 37.85)

# Ways that can be walked.
WALK_HIGHWAYS = (
    "footway", "path", "steps", "pedestrian", "living_street", "residential", "service", "unclassified",
    "road", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link",
    "cycleway", "track", "trunk", "trunk_link",
)
FOOT_ONLY_IF_ALLOWED = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway")
FOOT_DENIED = ("no", "private")
FOOT_ALLOWED = ("yes", "designated", "permissive")
RAIL_ROUTES = ("subway", "light_rail", "train", "monorail")
NOT_LIVE_KEYS = ("disused", "abandoned", "construction", "proposed", "disused:railway", "construction:railway")
NOT_LIVE_VALUES = ("yes", "station", "halt")

# Walking limit, speed and snapping distances in metres (per minute).
WALK_LIMIT_M = 1300
WALK_SPEED = 65
SNAP_ORIGIN_M = 150
SNAP_ENDPOINT_M = 80
MERGE_STATION_M = 600
EDGE_MAX_M = 5000
