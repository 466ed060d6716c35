"""Fixed values of the air-quality domain: stations, header names, windows, calendar, presets.

Everything here is data that results depend on; the operators take all of it as arguments.
"""

# --- fixed values -----------------------------------------------------------------------------

LONDON_STATIONS = ["BL0", "CD1", "CD9", "GN0", "GN3", "GR4", "GR9", "HV1", "KF1", "LW2", "MY7", "ST5", "TH4"]

# Chinese header of the Beijing daily files -> station id
BEIJING_HEADERS = {
    "东四": "dongsi_aq",
    "天坛": "tiantan_aq",
    "官园": "guanyuan_aq",
    "万寿西宫": "wanshouxigong_aq",
    "奥体中心": "aotizhongxin_aq",
    "农展馆": "nongzhanguan_aq",
    "万柳": "wanliu_aq",
    "北部新区": "beibuxinqu_aq",
    "植物园": "zhiwuyuan_aq",
    "丰台花园": "fengtaihuayuan_aq",
    "云岗": "yungang_aq",
    "古城": "gucheng_aq",
    "大兴": "daxing_aq",
    "亦庄": "yizhuang_aq",
    "通州": "tongzhou_aq",
    "顺义": "shunyi_aq",
    "昌平": "pingchang_aq",
    "门头沟": "mentougou_aq",
    "平谷": "pinggu_aq",
    "怀柔": "huairou_aq",
    "密云": "miyun_aq",
    "延庆": "yanqin_aq",
    "定陵": "dingling_aq",
    "八达岭": "badaling_aq",
    "密云水库": "miyunshuiku_aq",
    "东高村": "donggaocun_aq",
    "永乐店": "yongledian_aq",
    "榆垡": "yufa_aq",
    "琉璃河": "liulihe_aq",
    "前门": "qianmen_aq",
    "永定门内": "yongdingmennei_aq",
    "西直门北": "xizhimenbei_aq",
    "南三环": "nansanhuan_aq",
    "东四环": "dongsihuan_aq",
    "房山": "fangshan_aq",
}

LONDON_HEADERS = {
    "MeasurementDateGMT": "utc_time",
    "PM2.5 Particulate (ug/m3)": "PM2.5",
    "PM10 Particulate (ug/m3)": "PM10",
}

MEASURE_NAMES = {"PM2.5": "pm25", "PM10": "pm10", "O3": "o3"}

CITY_FEED_COLUMNS = ["station", "ts", "pm25", "pm10", "no2", "co", "o3", "so2"]

GOLDEN_WINDOWS = [11, 18, 30, 48, 78, 126, 203, 329]
FIB_WINDOWS = [7, 14, 21, 35, 56, 91, 147, 238, 385]

HOLIDAYS = {
    "new_year": ["2017-01-02", "2018-01-01", "2018-01-02"],
    "chinese_new_year": [
        "2017-01-27", "2017-01-28", "2017-01-29", "2018-02-15", "2018-02-16", "2018-02-17",
    ],
    "labor_day": ["2017-05-01", "2017-05-02", "2017-05-03", "2018-05-01", "2018-05-02", "2018-05-03"],
    "qin_ming": ["2017-04-02", "2017-04-03", "2017-04-04", "2018-04-04", "2018-04-05", "2018-04-06"],
    "dragon_boat": ["2017-05-28", "2017-05-29", "2017-05-30"],
    "golden_week": ["2017-10-01", "2017-10-02", "2017-10-03"],
    "mid_autum": ["2017-10-04"],
    "work_weekend": ["2017-01-22", "2017-02-04", "2017-04-01", "2017-05-27", "2017-07-30"],
}

BEIJING_UTC_OFFSET_HOURS = 8
HISTORY_START = "2017-01-02"
EXCLUDED_FROM_TRAINING = "zhiwuyuan_aq"
MAX_MISSING_NEIGHBORS = {"beijing": 17, "london": 6}

CURVE_HISTORY_DAYS = [475, 294, 181, 112]
CURVE_CUT_HOURS = 9

# windows and summary of the medians; history, strength and changepoints of the curve; history,
# windows, dropout, layer sizes and batch of the net
CITY_PRESETS = {
    "beijing": {
        "windows": "golden_5", "method": "median", "history_days": 475, "strength": 0.003, "changepoints": 67,
        "lag_history_days": 360, "lag_windows": "golden_8", "dropout": 0.6, "units": (48, 48, 48, 48), "batch": 84,
    },
    "london": {
        "windows": "fib_9", "method": "median", "history_days": 475, "strength": 0.001, "changepoints": 67,
        "lag_history_days": 420, "lag_windows": "fib_8", "dropout": 0.2, "units": (24, 24, 24, 24), "batch": 22,
    },
}

# --- derived from the fixed values ------------------------------------------------------------

BEIJING_STATIONS = sorted(BEIJING_HEADERS.values())
CITY_OF = {**dict.fromkeys(BEIJING_STATIONS, "beijing"), **dict.fromkeys(LONDON_STATIONS, "london")}
ABSENT = {"o3": tuple(LONDON_STATIONS)}


def window_family(name: str) -> list[int]:
    """Days of a named family: ``golden_4`` ... ``golden_8``, ``fib_5`` ... ``fib_9``."""
    kind, _, size = name.partition("_")
    days = {"golden": GOLDEN_WINDOWS, "fib": FIB_WINDOWS}[kind]
    return days[: int(size)]


WINDOW_FAMILIES = [f"golden_{n}" for n in (8, 7, 6, 5, 4)] + [f"fib_{n}" for n in (9, 8, 7, 6, 5)]
