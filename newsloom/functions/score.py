"""Relevance scores of paragraphs: lexicons, decision list and weighted sums.

Lexicons are fixed values: results match only with the same terms. ``Lexicon`` lets other languages bring theirs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col, full_stops, hits, holds_any, strip

#: Words that are no keywords. Fixed values.
STOP_WORDS = frozenset("the of is and to in that we for an are by be as on with can if from which you it this then at have all not one has or".split())

BASE_THRESHOLD = 0.2
LEAST_CHARS = 25


@dataclass(frozen=True)
class Lexicon:
    """Terms and patterns of the decision list. Fixed values."""

    keep: list[str] = field(default_factory=lambda: [
        "地震", "台风", "洪水", "火灾", "灾害", "灾难", "灾情", "受灾", "防灾", "减灾", "应急", "救援", "疏散", "避难", "安全", "防护", "震级", "震中", "震源", "余震", "震感", "震波", "震度",
        "建筑", "设施", "结构", "房屋", "学校", "医院", "公园", "避难所", "损坏", "倒塌", "裂缝", "倾斜", "加固", "整修", "维护", "修复", "历史", "文化", "保护", "遗产", "古迹", "文物", "保存",
        "政府", "部门", "机构", "组织", "管理", "规划", "政策", "措施", "数据", "统计", "报告", "分析", "评估", "监测", "预警", "预测", "地区", "城市", "省份", "县市", "乡镇", "街道", "社区",
        "居民", "民众", "市民", "村民", "住户", "家庭",
    ])
    figures: str = r"[0-9]{4}年|[0-9]+(?:月|日|人|元|%|级|度|次)"
    places: str = r"[\p{L}\p{N}_](?:市|县|区|镇|村|街道|社区|学校|医院|公园|省|自治区|直辖市)"
    says: list[str] = field(default_factory=lambda: [
        "表示", "说", "称", "透露", "指出", "强调", "认为", "介绍", "说明", "报道",
    ])
    drop: str = (
        r"订阅.*电子报|请输入.*格式|感谢.*订阅|每天.*分钟.*掌握.*件|早安世界.*电子报|分钟掌握.*件天下事|点击.*链接|关注.*公众号|下载.*APP|注册.*账号|版权.*所有|免责.*声明|隐私.*政策|使用.*条款"
        r"|^请输入.*$|^点击.*$|^订阅.*$|^感谢.*$"
    )
    critical: list[str] = field(default_factory=lambda: [
        "订阅", "电子报", "请输入", "电子信箱", "感谢", "早安世界", "分钟掌握", "天下事",
    ])
    formal: list[str] = field(default_factory=lambda: [
        "订阅", "点击", "输入", "感谢", "电子报", "请输入",
    ])
    important: list[str] = field(default_factory=lambda: [
        "地震", "台风", "洪水", "火灾", "灾害", "救援", "疏散", "避难", "伤亡", "损失", "防灾", "减灾", "应急", "安全", "防护", "预警", "监测", "评估", "重建", "修复", "建筑", "设施", "结构",
        "损坏", "倒塌", "裂缝", "倾斜", "加固", "整修", "维护", "历史", "文化", "保护", "遗产", "古迹", "文物",
    ])
    urgent: list[str] = field(default_factory=lambda: [
        "地震", "台风", "洪水", "火灾", "灾害", "救援", "疏散", "避难", "防灾", "减灾", "应急", "安全", "防护", "预警",
    ])
    times: list[str] = field(default_factory=lambda: [
        "今天", "昨日", "昨天", "近日", "最近", "目前", "现在", "当时", "事发",
    ])
    context_places: list[str] = field(default_factory=lambda: [
        "地区", "市", "县", "镇", "村", "街道", "社区", "学校", "医院", "商场",
    ])
    context_says: list[str] = field(default_factory=lambda: [
        "表示", "说", "称", "透露", "指出", "强调", "认为", "介绍",
    ])
    threshold_says: list[str] = field(default_factory=lambda: [
        "表示", "说", "称", "透露", "指出", "强调", "认为", "介绍", "说明",
    ])
    threshold_places: list[str] = field(default_factory=lambda: [
        "市", "县", "区", "镇", "村", "街道", "社区", "学校", "医院", "公园",
    ])


def whitelisted(p: Column, lex: Lexicon, keywords: Column | None = None) -> Column:
    """Lexicon term, figure with unit, place or verb of saying; or one of ``keywords`` (title and topic) longer than a character."""
    out = holds_any(p, lex.keep) | p.rlike(lex.figures) | p.rlike(lex.places) | holds_any(p, lex.says)
    if keywords is not None:
        out = F.exists(keywords, lambda k: (F.length(k) > 1) & F.contains(p, k)) | out
    return out


def blacklisted(p: Column, lex: Lexicon) -> Column:
    """Pattern, three critical words, or a short paragraph with a form word."""
    c = strip(p)
    return c.rlike(lex.drop) | (hits(c, lex.critical) >= 3) | ((F.length(c) < 50) & holds_any(c, lex.formal))


def threshold(p: Column, lex: Lexicon, base: float = BASE_THRESHOLD) -> Column:
    """Confidence below which a paragraph is dropped, from 0.05 to 0.5."""
    step = lambda cond, by: F.when(cond, F.lit(by)).otherwise(F.lit(0.0))
    out = F.lit(base) + step(F.length(p) < 50, 0.05) + step(holds_any(p, lex.urgent), -0.08) + step(p.rlike("[0-9]"), -0.05)
    out = out + step(holds_any(p, lex.threshold_says), -0.03) + step(holds_any(p, lex.threshold_places), -0.02)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.5), out))


def _capped(n: Column, weight: float, cap: float) -> Column:
    return F.least(n * F.lit(weight), F.lit(cap))


def context_relevance(p: Column, lex: Lexicon) -> Column:
    numbers = F.regexp_count(p, F.lit("[0-9]+"))
    parts = _capped(hits(p, lex.times), 0.1, 0.2) + _capped(hits(p, lex.context_places), 0.1, 0.2) + _capped(numbers, 0.05, 0.2) + _capped(hits(p, lex.context_says), 0.1, 0.2)
    return F.least(parts, F.lit(1.0))


def content_quality(p: Column) -> Column:
    """Length band, complete sentences and Han characters for each word."""
    n = F.length(p)
    band = F.when((n >= 50) & (n <= 500), 0.3).when(((n >= 25) & (n < 50)) | ((n > 500) & (n <= 800)), 0.2).otherwise(0.1)
    complete = F.size(F.filter(full_stops(p), lambda s: F.length(strip(s)) > 10))
    tokens = F.size(F.filter(F.split(p, r"[ \t\n\f\r]+"), lambda w: w != ""))
    density = F.when(tokens > 0, F.least(F.regexp_count(p, F.lit("[一-鿿]")) / tokens * 0.4, F.lit(0.4))).otherwise(0.0)
    return F.least(band + _capped(complete, 0.1, 0.3) + density, F.lit(1.0))


def keyword_relevance(p: Column, own: Column, title: Column, topic: Column, lex: Lexicon) -> Column:
    """Overlap of the paragraph's keywords with title and topic keywords, plus important terms."""
    share = lambda other: F.when(F.size(other) > 0, F.size(F.array_intersect(own, other)) / F.greatest(F.size(F.array_distinct(own)), F.lit(1))).otherwise(0.0)
    return F.least(share(title) * 0.4 + share(topic) * 0.3 + _capped(hits(p, lex.important), 0.08, 0.4), F.lit(1.0))


def confidence(similarity: Column, keyword: Column, context: Column, quality: Column) -> Column:
    return similarity * 0.25 + keyword * 0.35 + context * 0.25 + quality * 0.15


def importance(title_similarity: Column, topic_similarity: Column, n_chars: Column, keyword_density: Column) -> Column:
    """Weight of a segment, rounded to three places."""
    return F.round(title_similarity * 0.4 + topic_similarity * 0.3 + F.least(F.lit(1.0), n_chars / 200.0) * 0.2 + F.least(keyword_density * 2.0, F.lit(0.1)), 3)


def decision(p: Column | str, lex: Lexicon, score: Column, keywords: Column | None = None) -> Column:
    """First that applies: too short, whitelisted, blacklisted, below the threshold, else kept."""
    p = col(p)
    return (
        F.when(F.length(p) < LEAST_CHARS, "short").when(whitelisted(p, lex, keywords), "keep").when(blacklisted(p, lex), "blacklist").when(score < threshold(p, lex), "irrelevant").otherwise("keep")
    )


def quality_label(ratio: Column) -> Column:
    return F.when(ratio == 1.0, "Fully Successful").when(ratio >= 0.7, "Highly Successful").when(ratio >= 0.3, "Partially Successful").otherwise("Mainly Fallback")
