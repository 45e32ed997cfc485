"""Rule tables, and the matcher that turns one into a column expression or a Python predicate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STARTS, EQUALS, CONTAINS = "starts", "equals", "contains"
Rules = dict[str, tuple[str, ...]]

# The wording of the rules by kind, matched on lower-cased text (section titles: on simplified characters).
TEMPLATES_DROPPED: Rules = {
    STARTS: ("cite", "main", "ref", "redirect"),
    EQUALS: (
        "reflist", "see also", "wikisource further reading", "wiktionary", "commonscat", "wayback", "notetag", "cjk-new-char",
        "-", "stem", "authority control", "efn", "r", "otheruses", "not", "about",
    ),
    CONTAINS: ("sidebar", "navigation", "学科", "侧边栏", "link"),
}
FIRST_TEMPLATES_KEPT: Rules = {EQUALS: ("noteta",)}
LINKS_DROPPED: Rules = {STARTS: ("file:", "category:")}
SECTIONS_DROPPED: Rules = {
    CONTAINS: ("参见", "参考", "参阅", "链接", "连接", "连结", "引用", "注释"),
    EQUALS: ("参看", "另见", "扩展阅读", "延伸阅读"),
}
LEAST_VIEWS, LEAST_LENGTH = 10_000, 500
# Frequent traditional characters and their simplified forms, one for one, for parsers that work without a session
# (all that occur in the rules above are among them). ``script.simplification`` has all of them.
TRADITIONAL = "參見閱連鏈結註釋擴讀獻頁書來時國學會長東車馬門間關開聞問義風飛電話語說請讓認識記計設許論證評詞試該詳誰課調談謝這進還過遠運達違適選遺邊鄉郵鄰醫釀錄錢鋼鐘鐵鎮鏡陣陽陰陸隊階際隨險雖雙難雲霧靈靜頂項順須預領頭題類願顯餘館駐驗體魚鳥麥黃點齊龍龜萬與業叢並亂於產億僅從倉儀價優兒內兩剛創劃劇劉動務勝勞勢區協單卻員啟喪圍圓圖團場壞塊塵壯聲處備夢夠夾奪奮婦寧實寶對尋導將屆層屬島嶺巖幣幫幾庫廣廳張強彈歸"
SIMPLIFIED = "参见阅连链结注释扩读献页书来时国学会长东车马门间关开闻问义风飞电话语说请让认识记计设许论证评词试该详谁课调谈谢这进还过远运达违适选遗边乡邮邻医酿录钱钢钟铁镇镜阵阳阴陆队阶际随险虽双难云雾灵静顶项顺须预领头题类愿显余馆驻验体鱼鸟麦黄点齐龙龟万与业丛并乱于产亿仅从仓仪价优儿内两刚创划剧刘动务胜劳势区协单却员启丧围圆图团场坏块尘壮声处备梦够夹夺奋妇宁实宝对寻导将届层属岛岭岩币帮几库广厅张强弹归"


def matches(text: Column, rules: Rules) -> Column:
    """Whether any rule holds for ``text``; constants fold, an empty table matches nothing."""
    tests = {STARTS: Column.startswith, EQUALS: Column.__eq__, CONTAINS: Column.contains}
    return reduce(Column.__or__, (tests[kind](text, F.lit(word)) for kind, words in rules.items() for word in words), F.lit(False))


def predicate(rules: Rules) -> Callable[[str], bool]:
    """The same as a Python function, for use inside parsers."""
    starts, equal, inside = rules.get(STARTS, ()), frozenset(rules.get(EQUALS, ())), rules.get(CONTAINS, ())
    return lambda text: text in equal or text.startswith(starts) or any(w in text for w in inside)
