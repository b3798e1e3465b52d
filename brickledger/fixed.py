"""Fixed values.

Everything in this module is data, not logic: the column names, header spellings, word lists,
patterns, thresholds and weights that define what a listings table means.  They have to be exactly
these for results to be right, so they are stated as plain text, once, and imported everywhere else.
"""

# --- Standard columns ------------------------------------------------------------------------------

STANDARD_COLUMNS = (
    "district", "community", "layout", "layout_normalized", "area_m2", "total_price", "unit_price",
    "floor", "floor_band", "orientation", "build_year", "list_date", "decoration", "followers",
    "listing_title", "house_info_raw", "follow_info_raw", "listing_id", "building_type",
    "description_raw", "description_hint_subway", "description_hint_school", "location_raw",
    "ingest_file",
    "area_m2_str", "area_m2_text", "layout_str", "orientation_str", "floor_text",
    "publish_time_raw", "listing_time", "followers_str", "decoration_str", "building_type_str",
    "tag_near_subway", "tag_near_bus", "tag_has_balcony", "tag_lighting",
    "tag_subway_station_hint", "tag_elevator",
)

NUMERIC_COLUMNS = ("area_m2", "total_price", "unit_price", "build_year", "followers")

# Header spellings seen in exported listing files, by the standard column they mean.
HEADER_ALIASES = {
    "district": ("城区", "区域", "行政区", "区县"),
    "community": ("小区", "楼盘", "小区名称"),
    "layout": ("户型", "房型", "室厅"),
    "area_m2": ("建筑面积", "面积", "建面", "㎡", "平米"),
    "total_price": ("总价", "挂牌价", "价格", "万元"),
    "unit_price": ("单价", "元/㎡", "元/m²"),
    "floor": ("楼层", "所在楼层"),
    "floor_band": ("楼层档", "低中高层"),
    "orientation": ("朝向",),
    "build_year": ("建筑年代", "建成年代", "房龄", "年代"),
    "list_date": ("挂牌日期", "挂牌时间"),
    "listing_time": ("挂牌时间文本",),
    "decoration": ("装修", "装修情况", "装修类型"),
    "followers": ("关注", "关注人数", "关注度"),
    "listing_title": ("房源标题", "标题"),
    "house_info_raw": ("房屋信息", "房源信息"),
    "follow_info_raw": ("关注信息",),
    "listing_id": ("房源编号", "编号"),
    "building_type": ("建筑类型", "房屋类型", "物业类型"),
    "description_raw": ("描述",),
    "location_raw": ("位置信息",),
}

# (staging column, canonical column) in the order in which staging values are promoted.
STAGING_PAIRS = (
    ("area_m2_str", "area_m2"),
    ("area_m2_text", "area_m2"),
    ("layout_str", "layout"),
    ("orientation_str", "orientation"),
    ("floor_text", "floor"),
    ("decoration_str", "decoration"),
    ("building_type_str", "building_type"),
)

# Staging columns an export leaves out once their canonical column is there.
EXPORT_REDUNDANT = STAGING_PAIRS + (
    ("followers_str", "followers"),
    ("publish_time_raw", "listing_time"),
    ("layout", "layout_normalized"),
)

# Preferred columns to tell listings apart when there is no usable listing number.
DEDUP_PREFERENCE = (
    "listing_id", "community", "layout", "area_m2", "house_info_raw", "listing_title",
    "description_raw", "location_raw", "follow_info_raw", "total_price", "unit_price", "district",
)
# Least share of filled cells of a usable column, and of different listing numbers if they are to do alone.
DEDUP_MIN_FILLED, DEDUP_MIN_DISTINCT = 0.05, 0.92

# --- Cells that mean "nothing here" ----------------------------------------------------------------

BLANK_WORDS = ("", "nan")
NULL_WORDS = ("", "nan", "none", "null")
MEANINGLESS_WORDS = ("", "nan", "none", "null", "待定")

# Cells a CSV reader takes as missing.
CSV_NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Parsing patterns and word lists ---------------------------------------------------------------

# (?U): \d and \s cover full-width digits and spaces.  (?d): only \n ends a line.  (?i) is in the
# patterns with Latin letters only: caseless matching makes the word lists much slower.
FLAGS = "(?Ud)"

NUMBER = r"(\d+(?:\.\d+)?)"
UNIT_PRICE = r"(?i)(\d+(?:\.\d+)?)\s*(万)?\s*(?:元)?\s*(?:/)?\s*(?:㎡|平米|m²|m2|M2)"
TOTAL_PRICE_WAN = r"(\d+(?:\.\d+)?)\s*万"
FOLLOWERS = r"(\d+(?:\.\d+)?)\s*(万|千|w|W)?"
LAYOUT_CELL = r"\d+\s*室\s*\d+\s*厅"
AREA_CELL = r"(?i)(\d+(?:\.\d+)?)\s*(?:平米|㎡|m²|m2|M2)"
YEAR_CELL = r"(19\d{2}|20\d{2})"
YEAR_TEXT = r"(19\d{2}|20[0-3]\d)"
FLOOR_WORD = r"(低层|中层|高层|低区|中区|高区|一楼顶楼)"
FLOOR_RATIO = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
USUAL_FLOOR_RATIO = r"^[0-9]{1,9}/[0-9]{1,9}\z"
ROOM_COUNT = r"(\d+)\s*室"
LONE_ROOM_COUNT = r"^([0-9]++)室[^室]*+$"
HALL_COUNT = r"(\d+)\s*厅"
LAYOUT_ROOMS_HALLS = r"(\d+)\s*室\s*(\d+)\s*厅"

# Rooms by wording, in the order in which they are tried.
ROOM_WORDS = (
    (2, r"两居|二居|两房|二房|两室|二室|2\s*居|2\s*房"),
    (3, r"三居|三房|3\s*居|3\s*房|三室"),
    (1, r"一居|一房|1\s*居|1\s*房|一室"),
    (4, r"四居|四房|4\s*居|4\s*房|四室"),
)

TOTAL_PRICE_YUAN_FROM = 50_000

# In order of priority.
ORIENTATIONS = (
    "南北通透", "东南", "西南", "东北", "西北", "南北", "东西",
    "朝南", "朝北", "朝东", "朝西", "南", "北", "东", "西",
)
ORIENTATION_MAX_CHARS = 16

HOUSE_INFO_DECORATIONS = (
    ("精装", ("精装", "精装修")),
    ("简装", ("简装", "普通装修")),
    ("毛坯", ("毛坯", "清水")),
    ("豪装", ("豪装", "豪华")),
)
DECORATIONS = (
    ("毛坯", ("毛坯", "清水")),
    ("简装", ("简装", "普通装修")),
    ("精装", ("精装", "精装修")),
    ("豪装", ("豪装", "豪华")),
)
# A house-info cell in the usual order, which needs no search for its parts: each is the first that its column accepts,
# and no column accepts one that belongs to a later column.
USUAL_HOUSE_INFO = (
    r"^[0-9]+室[0-9]+厅\|[0-9]+(?:\.[0-9]+)?平米\|[东南西北]{1,4}\|(?:精装|简装|毛坯|豪装)\|"
    r"[低中高]楼?层\(共[0-9]{1,3}层\)\|(?:19|20)[0-9]{2}年建\|(?:塔板结合|塔板|板楼|塔楼)$"
)
# Cells that are what is to be read out of them.
USUAL_LAYOUT = r"^(?:0|[1-9][0-9]*)室(?:0|[1-9][0-9]*)厅$"
USUAL_AREA = r"^[0-9]+(?:\.[0-9]+)?平米$"
USUAL_YEAR = r"^(?:19|20)[0-9]{2}年建$"
USUAL_PARTS = (
    "layout_str", "area_m2_str", "orientation_str", "decoration_str", "floor_text", "build_year", "building_type_str",
)
BUILDING_TYPES = ("塔板结合", "塔板", "板楼", "塔楼", "钢混", "砖混", "别墅", "洋房")

UNKNOWN = "未知"

# --- Text labels -----------------------------------------------------------------------------------

LABEL_TEXT_COLUMNS = ("description_raw", "location_raw", "listing_title", "house_info_raw")

# Every text that one of the subway patterns fits has one of these, and they are found much faster.
SUBWAY_MARKS = ("铁", "轨", "线", "站", "t", "T")
SUBWAY_NEGATION = (
    r"无地铁|未通地铁|未有地铁|没有地铁|非地铁|远离地铁|"
    r"暂不[临]?地铁|暂无地铁|未临地铁|暂无\s*地铁|不临地铁"
)
SUBWAY_KEYWORD = (
    r"(?i)地铁[房口旁上盖物业站]?|近地铁|临地铁|紧邻地铁|临近地铁|靠近地铁|"
    r"距地铁|出门[即就是]?地铁|轨交|轨道交通|轻轨|号\s*线|轨道\s*交通|"
    r"地铁\s*上盖|地铁\s*直连|地铁\s*入户|地铁\s*出行|地铁\s*通勤|"
    r"距\s*\d{1,2}\s*号?\s*线|"
    r"(?:^|[^a-z])tod(?:$|[^a-z])|"
    r"tod项目|地铁tod|轨交tod"
)
SUBWAY_STATION_DISTANCE = (
    r"距(?!.{0,14}?(?:公交|巴士|汽车|客运|高铁|动车))"
    r"(?!.{0,14}?(?:火车\s*站|高铁站|火车站|汽车站|客运站))"
    r".{1,22}?"
    r"站\s*\d{2,6}\s*[mM米]"
)
SUBWAY_LINE_DISTANCE = (
    r"距.{0,24}?(?:地铁|[\d一二三四五六七八九十两〇○百零]+号\s*线).{0,20}?\d{2,6}\s*[mM米]"
)
SUBWAY_INLINE_DISTANCE = (
    r"地铁.{0,18}\d{2,5}\s*[mM米]|[\d一二三四五六七八九十两〇○百零]+号\s*线.{0,16}\d{2,5}\s*[mM米]"
)
SUBWAY_WALK = (
    r"步行\s*\d{1,3}\s*分钟(?:内\s*)?[到至]?"
    r"[^\n。,，;；]{0,26}(?:地铁|号\s*线|轻轨|地铁站|地铁口|轨道交通|轨交)"
)
# Words, looked for as they are; longer ones that have one of these in them go without saying.
BUS = ("公交", "巴士站")
BALCONY = ("阳台", "露台", "观景台", "外挑")
LIGHTING = ("采光", "通透", "全明", "明厨", "明卫", "视野好", "无遮挡", "亮堂", "日照充足", "自然光")
ELEVATOR = ("电梯", "梯户", "一梯一户", "两梯四户")

SUBWAY_STATIONS = (
    "凤溪河", "南熏大道", "光华公园", "涌泉", "杨柳河", "市五医院", "金星", "明光", "非遗博览园",
    "黄田坝", "文化宫", "中医大省医院", "天府广场", "春熙路", "世纪城", "孵化园", "金融城",
    "交子大道", "石羊", "三元", "太平园", "红牌楼", "高升桥", "省体育馆", "倪家桥", "桐梓林",
    "火车南站", "三瓦窑", "琉璃场", "东大路", "牛市口", "牛王庙", "东门大桥", "红星桥", "前锋路",
    "梁家巷", "人民北路", "西北桥", "九里堤", "西南交大", "茶店子", "羊犀立交", "一品天下",
    "金沙博物馆", "清江西路", "成都西站", "中坝", "蔡桥", "凤凰大街", "温泉大道", "九江北",
    "白佛桥", "康河", "万盛",
)

BUILD_YEAR_RANGE = (1900, 2035)

# --- Analysis --------------------------------------------------------------------------------------

# Right-closed area bands: label, lower bound, upper bound.
AREA_BANDS = (
    ("<=60", 0, 60),
    ("60-90", 60, 90),
    ("90-120", 90, 120),
    ("120-150", 120, 150),
    (">150", 150, 10_000),
)
MIN_ROWS = 5
IQR_MIN_ROWS = 10
IQR_FACTOR = 1.5
TOP_LAYOUTS = 12
TOP_COMMUNITIES = 15
HISTOGRAM_BINS = (10, 40)

# Analysis tasks with the columns they need, in the order in which they are offered.
ANALYSIS_TASKS = (
    ("district_price_rank", ("district", "unit_price")),
    ("layout_price_box", ("layout", "unit_price")),
    ("area_band_price", ("area_m2", "unit_price")),
    ("area_band_share_pie", ("area_m2",)),
    ("decoration_price_compare", ("decoration", "unit_price")),
    ("floor_band_price", ("floor_band", "unit_price")),
    ("building_age_price_trend", ("build_year", "unit_price")),
    ("community_followers_rank", ("community", "followers")),
    ("total_area_scatter", ("area_m2", "total_price")),
    ("unit_price_histogram", ("unit_price",)),
    ("price_outlier_flag", ("unit_price",)),
)

# --- Quality ---------------------------------------------------------------------------------------

QUALITY_DEFAULTS = {
    "min_rows": 25,
    "min_retention_ratio": 0.02,
    "min_unit_price_coverage": 0.15,
    "min_geo_coverage": 0.15,
}
RETENTION_BLOCK = 0.5
RETENTION_MIN_RAW_ROWS = 50
SUBWAY_SHARE_WARN = 0.3
UNIT_PRICE_VALID = (30, 600_000)
DERIVABLE_SHARE = 0.2
UNIT_PRICE_SPARSE = 0.5

# --- Search ----------------------------------------------------------------------------------------

GEO_COLUMNS = ("district", "location_raw", "listing_title", "community")
SEARCH_TEXT_COLUMNS = (
    "description_raw", "house_info_raw", "location_raw", "listing_title", "follow_info_raw",
    "community",
)
DISPLAY_COLUMNS = (
    "district", "community", "layout", "layout_normalized", "area_m2", "total_price", "unit_price",
    "floor", "floor_band", "orientation", "decoration", "build_year", "building_type",
    "listing_title", "location_raw", "house_info_raw", "follow_info_raw", "listing_id",
    "tag_near_subway", "tag_near_bus", "tag_has_balcony", "tag_lighting",
    "tag_subway_station_hint", "tag_elevator",
)
DISPLAY_MAX_CHARS = 160

PARKING_WORDS = ("车位", "停车位", "车库出售", "产权车位", "人防车位")
ABSURD_ROOMS = 10
FAMILY_ROOMS = (2, 6)
SUBWAY_WORDS = ("地铁", "号线", "轨道")
BALCONY_WORDS = ("阳台", "露台")
LIGHTING_WORDS = ("采光", "通透", "全明")

# Part of a district name, and the other names under which that district is listed.
DISTRICT_ALIASES = (
    ("高新", ("高新", "高新区", "成都高新", "高新城南", "新川科技园", "新川")),
    ("天府", ("天府新区", "天府", "天新")),
    ("温江", ("温江", "温江区")),
    ("锦江", ("锦江", "锦江区")),
    ("武侯", ("武侯", "武侯区")),
    ("青羊", ("青羊", "青羊区")),
    ("金牛", ("金牛", "金牛区")),
    ("成华", ("成华", "成华区")),
    ("郫", ("郫都", "郫都区", "郫县")),
    ("双流", ("双流", "双流区")),
    ("龙泉", ("龙泉驿", "龙泉驿区", "龙泉")),
    ("新都", ("新都", "新都区")),
)

# Score weights.  A "near" price is above the asked maximum by at most the given factor.
GEO_SCORE, GEO_TEXT_SHARE = 120.0, 0.22
COMMUNITY_SCORE, COMMUNITY_TEXT_SHARE = 95.0, 0.35
LAYOUT_SCORE, LAYOUT_TEXT_SHARE = 75.0, 0.2
PRICE_IN_RANGE, PRICE_NEAR, PRICE_MIN_SHARE = 55.0, 22.0, 0.85
UNIT_PRICE_NEAR_FACTOR, TOTAL_PRICE_NEAR_FACTOR = 1.2, 1.15
STATION_SCORE = 100.0
SUBWAY_TAG, SUBWAY_TEXT, SUBWAY_CAP = 55.0, 50.0, 85.0
BALCONY_TAG, BALCONY_TEXT, BALCONY_CAP = 45.0, 40.0, 70.0
LIGHTING_TAG, LIGHTING_TEXT, LIGHTING_CAP = 40.0, 35.0, 65.0
YEAR_OK, YEAR_NEAR, YEAR_NEAR_SPAN = 45.0, 18.0, 8
PARKING_PENALTY, ABSURD_PENALTY = 600.0, 550.0
FAMILY_BONUS = 110.0
NO_PRICE = 1e18
SEARCH_ROWS = 15

# --- Report and scoring ----------------------------------------------------------------------------

REPORT_SAMPLE_ROWS = 5_000
PROFILE_SAMPLES, PROFILE_SAMPLE_CHARS, PROFILE_MAX_COLUMNS = 3, 120, 48
SCORING_ROWS, SCORING_SEED, SCORING_SNIPPET_CHARS = 200, 42, 400
# The library's own default: one row in a hundred.
SCORING_SHARE = 0.01
