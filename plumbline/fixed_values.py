"""Names, keywords and constants that must be exactly these for right results."""

# Column names taken for datetimes (compared in lower case).
DATETIME_NAMES = ["date", "time", "datetime", "timestamp", "销售日期", "日期", "时间"]

# Name parts that make a column a datetime candidate in a dataset profile.
DATETIME_NAME_PARTS = ["date", "time", "datetime"]

# Name parts for the loose datetime conversion on load.
LOOSE_DATETIME_PARTS = ["日期", "time"]

# Accepted datetime patterns, tried in this order.
DATETIME_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyyMMdd",
    "MM/dd/yyyy",
)

# Length range of a string sampled as a possible datetime.
DATETIME_LENGTHS = (8, 20)

# Names and name parts that cannot be a target in the feature stage.
NON_TARGET_NAMES = ["id", "index", "year", "month", "day", "quarter", "日期", "时间"]
NON_TARGET_PARTS = ["id", "index", "year", "month", "day"]

# Keywords that mark a target in the analysis stage.
TARGET_KEYWORDS = ["利润", "销售额", "销量", "收入", "price", "sales", "revenue", "profit"]

# Name parts that make a feature a sign of a time series.
TIME_FEATURE_PARTS = ["month", "quarter", "day_of_week", "year", "week_of_year"]

# Suffixes of calendar columns, first and second set.
CALENDAR_SUFFIXES = ["年份", "月份", "日", "星期", "星期名称"]
CALENDAR_FEATURE_SUFFIXES = ["季度", "是否周末", "月份名称", "年月", "月初", "月中", "月末"]

# The column left out of the categorical list on load.
EXCLUDED_CATEGORICALS = ["产品名称"]

# Keywords of the key-figure roles; Chinese parts match as is, others in lower case.
ROLE_KEYWORDS = {
    "price": ["价格", "price"],
    "quantity": ["销量", "sales", "quantity"],
    "cost": ["成本", "cost"],
    "profit": ["利润", "profit", "income"],
    "revenue": ["销售额", "revenue"],
    "product": ["产品", "product"],
    "region": ["地区", "区域", "region"],
}

# Keywords of the default hypothesis tests.
TEST_ROLE_KEYWORDS = {
    "promotion": ["促销", "promotion"],
    "sales": ["销量", "sales"],
    "category": ["类别", "category"],
    "region": ["地区", "region"],
    "amount": ["销售额", "sales"],
}

# What-if parameter names and the column keywords they touch.
PARAMETER_KEYWORDS = {
    "profit_margin_volatility_threshold": ["利润率", "profit_margin"],
    "allocation_adjustment_range": ["销售额", "销量", "revenue", "sales"],
    "price_change_range": ["价格", "price"],
    "cost_reduction_targets": ["成本", "cost"],
    "price_cost_ratio_threshold": ["价格成本比", "price_cost_ratio"],
    "promotion_profit_margin_threshold": ["利润率", "profit_margin"],
    "sales_volume_increase_targets": ["销量", "sales", "volume"],
    "weekend_vs_weekday_multiplier": ["销量", "销售额", "sales", "revenue"],
    "monthly_sales_variation_range": ["销量", "销售额", "sales", "revenue"],
    "worst_case_scenario_drop": ["销量", "销售额", "sales", "revenue"],
    "product_mix_profitability_target": ["利润率", "profit_margin"],
    "cross_sell_ratio_increase": ["销量", "销售额", "sales", "revenue"],
    "low_performer_cutoff_threshold": ["利润率", "profit_margin"],
    "cost_to_sales_ratio_targets": ["成本", "cost", "销售额", "sales"],
    "efficiency_improvement_potential": ["成本", "cost"],
    "region_performance_gap_threshold": ["销售额", "利润", "sales", "profit"],
    "key_performance_indicators": ["销售额", "利润", "利润率", "sales", "profit", "margin"],
}

# Columns of the fallback adjustment and of the scenario total.
COST_NAME_PARTS = ["成本", "cost"]
FALLBACK_NAME_PARTS = ["销售额", "利润", "revenue", "profit"]
TOTAL_NAME_PARTS = ["销售额", "利润"]
CURRENT_TOTAL_COLUMNS = ["销售额", "利润"]
THRESHOLD_FACTOR = 1.05

# The declared business scenarios, in percent.
CONFIG_SCENARIOS = {
    "sales_increase": [10, 20, 30],
    "price_change": [-5, 0, 5],
    "cost_reduction": [5, 10, 15],
}

# Text chunk size, overlap and separators; neighbours returned by a search.
CHUNK_SIZE = 250
CHUNK_OVERLAP = 25
CHUNK_SEPARATORS = ["\n\n", "\n", " ", ""]
SEARCH_NEIGHBOURS = 200
UNKNOWN_LABEL = "未知"
SEARCH_HEADER = "已找到以下相关数据分析API信息:"

# Chart settings.
HISTOGRAM_BINS = 20
DENSITY_POINTS = 200
BOOTSTRAP_RESAMPLES = 1000
BOX_WHISKER = 1.5
