"""Captions, topics, names and small text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Topics with the words that make a caption belong and those that rule it out.
TOPICS: dict[str, tuple[str, list[str], list[str]]] = {
    "美食": ("utensils-crossed", ["美食", "食物", "料理", "甜點", "蛋糕", "烤肉", "火鍋", "餐廳", "拉麵", "壽司", "披薩", "漢堡", "便當", "下午茶", "佳餚", "早餐", "晚餐", "午餐", "炒飯", "炒麵", "餃子", "包子", "燒烤", "咖啡廳", "甜品", "點心", "菜餚", "小吃", "飯店餐", "麵食", "湯品"], []),
    "山景": ("mountain", ["山脈", "山頂", "登山", "山巒", "山稜", "山林", "高山", "山谷", "山坡", "山色", "山岳", "群山", "山景", "眺望群山", "山中", "山間"], ["中山", "山田", "山口", "山本", "山內", "山下", "河山", "江山", "山寨", "山貨", "靠山", "座山", "山雞", "山豬", "山藥"]),
    "海景": ("waves", ["海邊", "沙灘", "海浪", "海岸", "海洋", "海面", "海景", "海濱", "海域", "浪花", "大海", "海水", "海湾", "海灣", "海滨", "海滩", "出海", "海平面", "遠眺海面"], ["劉海", "刘海", "瀏海", "上海", "海苔", "海鮮", "海鱼", "海派", "海綿", "海绵", "海報", "海报", "海內", "海关", "海關", "海軍", "海军", "海運", "海运", "海拔", "腦海", "脑海", "海量", "海口"]),
    "夜景": ("moon", ["夜景", "夜晚", "霓虹", "夜市", "夜色", "燈光秀", "煙火", "煙花", "華燈", "夜空", "深夜", "入夜", "夜幕", "萬家燈火"], ["子夜", "夜店", "夜半", "夜路", "夜深人靜", "夜以繼日"]),
    "建築": ("landmark", ["古蹟", "寺廟", "教堂", "神社", "佛塔", "古建築", "老建築", "傳統建築", "歷史建築", "現代建築", "摩天大樓", "紀念碑", "宮殿", "城堡", "廟宇"], []),
    "派對": ("party-popper", ["派對", "慶祝", "生日派對", "生日蛋糕", "聚餐", "聚會", "節日", "婚禮", "婚宴", "晚宴", "歡聚", "派对", "狂歡", "派对场景"], []),
    "天空": ("cloud-sun", ["日落", "日出", "彩霞", "雲海", "藍天", "晚霞", "彩虹", "夕陽", "朝陽", "雲彩", "火燒雲", "雲層", "碧空", "蒼穹"], []),
    "街景": ("traffic-cone", ["街道", "街景", "巷弄", "商店街", "老街", "市集", "市區", "鬧區", "鬧街", "街頭", "步行街", "購物街", "街市", "街角"], ["街道辦", "街頭巷尾(成語)", "華爾街", "百老匯"]),
    "植物": ("flower", ["花海", "櫻花", "油桐花", "花圃", "花園", "花田", "盆栽", "綠葉", "綠樹", "花朵", "鮮花", "玫瑰", "向日葵", "杜鵑", "繡球花", "百合", "薰衣草", "落葉", "秋葉", "紅葉"], ["花費", "花了", "花光", "花錢", "花心", "花樣"]),
}


def alternation(words: list[str]) -> str:
    """A pattern of the words, earlier ones preferred where two begin alike."""
    return "|".join(re.escape(w) for w in words)


def distinct_hits(label: Column, include: list[str], exclude: list[str]) -> Column:
    """Distinct leftmost matches of the included words; 0 if an excluded word occurs or label is null."""
    hits = F.size(F.array_distinct(F.regexp_extract_all(label, F.lit(f"({alternation(include)})"), F.lit(1))))
    barred = label.rlike(alternation(exclude)) if exclude else F.lit(False)
    return F.coalesce(F.when(barred, 0).otherwise(hits), F.lit(0))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]"), F.lit(False))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def short_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 8))


def response_text(response: Column) -> Column:
    """Text of a chat response: a string, or its text segments joined; else empty."""
    content = F.try_variant_get(F.try_parse_json(response), "$.choices[0].message.content", "variant")
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    part = lambda s, key: F.try_variant_get(s, f"$.{key}", "string")
    segments = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda s: F.coalesce(part(s, "type") == "text", F.lit(False)))
    return F.coalesce(plain, F.array_join(F.transform(segments, lambda s: F.coalesce(part(s, "text"), F.lit(""))), ""), F.lit(""))
