"""The listing, its raw sources, and the fixed values of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("image", T.StringType()),
        T.StructField("date", T.StringType(), False),
        T.StructField("city", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("is_tribute", T.BooleanType()),
        T.StructField("is_famous", T.BooleanType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
#: As files and uploads spell it.
LISTING_JSON = T.StructType([T.StructField("updatedAt" if f.name == "updated_at" else f.name, f.dataType) for f in LISTING])

STATUS = "status string, progress int, total int, current int, message string, lastUpdated long, result struct<success boolean, totalNew int, totalCombined int, message string, timedOutSources array<string>, failedSources array<string>>"

#: Pages of source B and C as landed (C's with the id and name of the location that they were asked for), and their city lists.
PAGE_B = "statusCode int, data struct<searchData array<struct<showId string, showName string, showDate string, showCity string, cityName string, venueName string, showStatusDisplayName string, priceInfo struct<prefix string, yuanNum string, suffix string>, tags array<struct<tagType string, tagName string>>>>, pagination struct<total int>>"
PAGE_C = "statusCode int, data array<struct<id string, title string, venueName string, location string, showDate string, imgUrl string, salePrice string, status string>>, locationId string, locationName string"
CITIES_B = "statusCode int, result struct<allCities array<struct<title string, cities array<struct<cityOID string, cityName string>>>>>"
LOCATIONS_C = "success boolean, data array<struct<id string, code string, name string>>"
CITIES_A = "hotCities array<struct<cityId string, cityName string, url string>>, hotCity array<struct<cityId string, cityName string, url string>>, groups array<struct<sites array<struct<cityId string, cityName string, url string>>>>"

# Fixed values.

#: A title with one of these is a tribute.
TRIBUTE_WORDS = ("烛光", "致敬", "模仿", "重现", "同人", "纪念", "追忆", "作品音乐会", "见面会", "金曲", "情歌", "表白")
#: A tag with one of these names no artist.
NOISE_TAGS = ("演唱会", "榜", "热销", "上新", "优选", "折扣", "推荐", "必看", "演出", "麦", "歌手", "音乐会")
#: Cities with one of these are not listed.
CITY_BLACKLIST = (
    "悉尼", "墨尔本", "布里斯班", "珀斯", "阿德莱德", "堪培拉", "奥克兰", "惠灵顿", "新西兰",
    "伦敦", "曼彻斯特", "爱丁堡", "伯明翰", "英国", "巴黎", "法国", "柏林", "慕尼黑", "法兰克福", "汉堡", "德国",
    "米兰", "罗马", "意大利", "马德里", "巴塞罗那", "西班牙", "阿姆斯特丹", "荷兰", "莫斯科", "圣彼得堡", "俄罗斯",
    "捷克", "布拉格", "瑞典", "斯德哥尔摩", "爱尔兰", "都柏林",
    "纽约", "洛杉矶", "旧金山", "拉斯维加斯", "芝加哥", "波士顿", "华盛顿", "西雅图", "多伦多", "温哥华", "蒙特利尔",
    "迪拜", "阿布扎比",
)
#: Traditional characters and their simplified ones, as far as titles, venues and cities here need them.
SIMPLIFIED = {
    "臺": "台", "台": "台", "灣": "湾", "週": "周", "雙": "双", "門": "门", "體": "体", "會": "会", "場": "场",
    "樂": "乐", "東": "东", "廣": "广", "國": "国", "羅": "罗", "區": "区",
}
#: Code of source C's location that is not crawled.
MAINLAND = "CN"
#: Stored artists that are none.
INVALID_ARTISTS = ("歌手", "音乐会")
#: Artists that a merge may replace, and that it never takes.
EMPTY_ARTISTS = ("Unknown", "群星", "待定", "歌手", "音乐会")
#: Holidays and moved workdays of 2026: first day, last day, type, name.
HOLIDAYS = (
    ("2026-01-01", "2026-01-03", "holiday", "元旦"),
    ("2026-01-04", "2026-01-04", "workday", "补班"),
    ("2026-02-14", "2026-02-14", "workday", "补班"),
    ("2026-02-15", "2026-02-23", "holiday", "春节"),
    ("2026-02-28", "2026-02-28", "workday", "补班"),
    ("2026-04-04", "2026-04-06", "holiday", "清明"),
    ("2026-05-01", "2026-05-05", "holiday", "劳动节"),
    ("2026-05-09", "2026-05-09", "workday", "补班"),
    ("2026-06-19", "2026-06-21", "holiday", "端午"),
    ("2026-09-20", "2026-09-20", "workday", "补班"),
    ("2026-09-25", "2026-09-27", "holiday", "中秋"),
    ("2026-10-01", "2026-10-07", "holiday", "国庆"),
    ("2026-10-10", "2026-10-10", "workday", "补班"),
)
WEEKDAYS = ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六")
#: Shares of the three sources in the overall progress.
PROGRESS_WEIGHTS = (0.55, 0.25, 0.20)
#: Backoff of source A and of sources B and C: first and longest wait in ms.
BACKOFF = {"a": (2000, 16000), "bc": (800, 6000)}
#: A running job is stale after, and a completed one fresh for, so many ms.
STALE_MS, COOLDOWN_MS = 5 * 60 * 1000, 4 * 60 * 60 * 1000
