"""Rules that classify notices in full: domains, genres and audiences, each with its grounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Domains in the order in which they are given, each with the words that mark it.
DOMAIN_WORDS = {
    "立法与司法": "立法 草案 仲裁 公证 调解 律师 法律援助 法律服务 司法鉴定 行政复议 监狱",
    "经济与产业": "产业 中小企业 市场主体 能源 电力 煤炭 石油 天然气 矿产 外商投资 招标投标 对外贸易 关税",
    "科技与互联网": "科学技术 科技创新 科技成果 高新技术 知识产权 专利 商标 著作权 人工智能",
    "教育与科研": "教育 学校 教师 学位 学科 科研 考试 招生",
    "医疗卫生": "医疗 医保 医药 药品 医院 医师 医生 护士 卫生 诊疗 疾病 疫苗 患者 传染病",
    "生态环境": "生态 环保 环境保护 污染 排放 碳排放 碳达峰 碳中和 自然保护地 自然保护区 野生动物 野生植物 森林 草原 湿地 海洋 固体废物 噪声",
    "交通运输": "交通 铁路 公路 道路 民航 航空 港口 轨道交通 邮政业 快递 车辆 船舶 航道 水运",
    "市场监管": "市场监管 市场准入 反垄断 反不正当竞争 公平竞争 社会信用 信用体系 失信惩戒 营商环境 产品质量 食品安全 特种设备 消费者权益 认证认可 标准化",
    "社会保障": "社会保险 社会救助 社会福利 最低生活保障 养老 就业 劳动 工资 工伤 失业 慈善 优抚 退役军人 残疾人",
    "数据与网络安全": "数据 网络安全 数据安全 个人信息 互联网 信息化 数字化 电子商务 算法 电信 无线电",
}

# Contexts in which a word doesn't count, and lines that tell of no subject: organisations in a list, contacts.
NOT_COUNTED = {"数据": "数据库", "信息化": "工业和信息化"}
ORGANISATIONS = "中国|国家|国际|部|委|局|厅|署|办|司|院|所|中心|站|集团|公司|协会|学会|联合会|大学|学院|基地|银行|委员会|研究所|研究院|编辑部|出版社|学校|医院|实验室|分会|企业"
LIST_LINE = rf"[^\S\n]*\d+[.．、](?=[^\n]*(?:{ORGANISATIONS}))[^\S\n]*[^。，、；：！？《》（）\n]{{2,40}}"
CONTACT_LINE = r"[^\S\n]*(?:地址|通讯地址|邮寄地址|联系地址|邮编|邮政编码)[^\S\n]*[：:][^\n]*"

# Notices whose audience is known by hand, by the beginnings of their ids, and the source that is for all.
OVERRIDES = {"954dcc17": "public", "61323da4": "sector", "c81057ef": "sector"}
PUBLIC_SOURCES = ("npc",)

# Patterns of titles that tell whom a notice is for; the first that fits decides.
AUDIENCE_RULES = (
    ("public", "law", r"中华人民共和国[^（(）)]{0,20}法\s*[（(][^）)]{0,20}(草案|征求意见稿)|(?<![办方做想用说合])法\s*[（(][^）)]{0,20}草案|条例\s*[（(][^）)]{0,20}(草案|征求意见稿)|国务院关于[^《》]{0,40}的规定"),
    ("public", "tax", r"税|关税|政府定价|价格听证"),
    ("public", "livelihood", r"社会保险|社保|医疗保险|医保|养老保险|养老金|失业保险|工伤保险|生育保险|最低生活保障|社会救助|住房公积金|就业|劳动合同|工资|消费者权益|消费者保护|食品安全|药品|疫苗|医疗器械|医疗服务|医疗机构|教育|学校|学位|招生|考试|教师|未成年人|儿童|青少年|老年人|妇女|残疾人|退役军人|慈善|殡葬|个人信息保护"),
    ("sector", "technical", r"标准|规程|规范|导则|通则|技术要求|技术条件|试验方法|测定|检测|检验|认证|认可|计量|定额|图集|编码|设计|施工|验收|运维|监测|方法学"),
    ("sector", "administration", r"许可|准入|资质|备案|审查细则|规范条件|管理办法|暂行办法|实施细则|认定|评估|评价|信用管理|招标|投标|政府采购|行业|产业|企业|生产|制造|装备|工程|运营|管道|管网|结构|材料|设施|设备|系统|专项规划|编制|名录|配额|行政复议|行政处罚|行政执法|登记|注册|核查|清单|信用|指引|实施规则|标识|单位制"),
    ("sector", "field", r"林业|草原|湿地|水利|水电|电力|电网|核电|核动力|煤炭|石油|天然气|油气|矿产|矿山|冶金|化工|建材|机械|汽车|车辆|船舶|游艇|航空|民航|铁路|公路|港口|航道|通信|无线电|软件|集成电路|半导体|农药|肥料|饲料|兽药|种子|农机|气象|测绘|海洋|地质|地震|辐射|烟火|爆炸|危险化学品|标准化|粮食"),
    ("sector", "list", r"名单|换届|委员|表彰|表扬|结果公示|审核结果|备案公告"),
)

# Genres. Titles of lists and packages come first, then amendments by attachments, then titles again.
LIST_TITLE = r"名单|表彰|表扬|通过审核|换届|备案公告|结果公示|拟.{0,4}奖励"
PACKAGE_TITLE = r"等\s*\d+\s*[项个件]|年度.{0,6}计划|计划项目|立项|项目清单"
COMPARISON_NAME = "对照"
AMENDING_WORDS = ("修改为", "删去", "增加一条", "原条款")
AMENDMENT_TITLE = r"修正|修订"
DRAFT_TITLE = r"草案|征求意见稿|办法|规定|规则|规程|导则|规范|指南|条例|实施细则|技术文件"

#: Grounds of a genre, the weakest first; a decision is replaced only by one on grounds at least as strong.
GROUNDS = ("none", "title", "attachment_names", "attachment_text")


def domain_tags(title: Column, body: Column, dropped_lines: str | None = f"{LIST_LINE}|{CONTACT_LINE}", not_counted: dict[str, str] | None = NOT_COUNTED) -> Column:
    """Domains whose words title or body hold, in the table's order.

    ``dropped_lines`` (a pattern of whole lines) go before the body is searched; ``not_counted`` maps
    a word to a pattern of contexts in which it doesn't count.
    """
    text = F.coalesce(body, F.lit(""))
    if dropped_lines:
        text = F.regexp_replace(text, f"(?m)^(?:{dropped_lines})$", "")
    text = F.lower(F.concat_ws("\n", title, text))
    plain, special = text, {word: F.regexp_replace(text, pattern, "") for word, pattern in (not_counted or {}).items()}
    found = []
    for domain, words in DOMAIN_WORDS.items():
        usual = [w for w in words.split() if w not in special]
        hit = plain.rlike("|".join(usual)) if usual else F.lit(False)
        for word in words.split():
            if word in special:
                hit = hit | F.contains(special[word], F.lit(word))
        found.append(F.when(hit, F.lit(domain)))
    return F.array_compact(F.array(*found))


def audience_decision(title: Column, source: Column, overrides: dict[str, str] | None = OVERRIDES, key: Column | None = None, public_sources: tuple = PUBLIC_SOURCES) -> Column:
    """(audience, grounds): by hand for keys with a known beginning, by source, by the title's first pattern, else unknown."""
    title = F.coalesce(title, F.lit(""))
    cases = [(F.startswith(key, F.lit(start)), F.lit(audience), F.lit("override")) for start, audience in (overrides or {}).items() if key is not None]
    if public_sources:
        cases.append((source.isin(*public_sources), F.lit("public"), F.lit("source")))
    for audience, name, pattern in AUDIENCE_RULES:
        hit = F.regexp_extract(title, f"({pattern})", 1)
        cases.append((hit != "", F.lit(audience), F.concat(F.lit(name + ":"), hit)))
    struct = lambda c: F.struct(c[1].alias("audience"), c[2].alias("grounds"))
    chosen = reduce(lambda w, c: w.when(c[0], struct(c)), cases[1:], F.when(cases[0][0], struct(cases[0])))
    return chosen.otherwise(F.struct(F.lit("unknown").alias("audience"), F.lit("none").alias("grounds")))


def genre_decision(title: Column, names: Column, text: Column) -> Column:
    """(genre, grounds, hit) from a title, its attachments' names and their text; null parts count as empty."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.coalesce(F.try_element_at(F.filter(names, lambda x: F.contains(x, F.lit(COMPARISON_NAME))), F.lit(1)), F.lit(""))
    marker = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in AMENDING_WORDS], F.lit(""))
    in_title = lambda pattern: F.regexp_extract(title, f"({pattern})", 1)
    rules = [
        ("list_or_result", "title", in_title(LIST_TITLE)),
        ("package_plan", "title", in_title(PACKAGE_TITLE)),
        ("amendment", "attachment_names", name),
        ("amendment", "attachment_text", marker),
        ("amendment", "title", in_title(AMENDMENT_TITLE)),
        ("new_draft", "title", in_title(DRAFT_TITLE)),
    ]
    struct = lambda genre, grounds, hit: F.struct(F.lit(genre).alias("genre"), F.lit(grounds).alias("grounds"), hit.alias("hit"))
    chosen = reduce(lambda w, r: w.when(r[2] != "", struct(*r)), rules[1:], F.when(rules[0][2] != "", struct(*rules[0])))
    return chosen.otherwise(struct("unknown", "none", F.lit("")))


def grounds_rank(grounds: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GROUNDS]), grounds).cast("int"), F.lit(0))
