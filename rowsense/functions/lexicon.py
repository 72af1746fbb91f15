"""Lexicons of notes, as parameters that operators take: what negates or hedges, units of doses, frequencies, drugs, directives,
findings. The values are fixed: results depend on each entry. Tables of forms are built from them by rules."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field


def listed(text: str) -> tuple[str, ...]:
    """Entries between bars."""
    return tuple(x.strip() for x in text.split("|"))


# How sure a marker is of its finding.
RANKS = {"definite-absent": 5, "compatible": 4, "probable": 3.5, "favored": 3.5, "suggestive": 3, "suspected": 3, "possible": 2, "differential": 2, "to-be-excluded": 1.5, "cannot-exclude": 1, "pending": 0.5, "pending-workup": 0.5, "follow-up-advised": 0.5}
# Markers by language and strength, in their order.
MARKERS = [
    ("en", "definite-absent", listed("no|not|without|denies|denied|negative for|absence of|free of|ruled out|no evidence of|unremarkable|non-|resolved")),
    ("en", "cannot-exclude", listed("cannot exclude|cannot rule out")),
    ("en", "suspected", listed("suspicious for|suggestive of")),
    ("en", "compatible", ("consistent with",)),
    ("en", "possible", listed("possible|query")),
    ("en", "probable", listed("probable|likely")),
    ("en", "to-be-excluded", ("r/o",)),
    ("en", "differential", listed("vs|differential")),
    ("en", "pending", listed("to be confirmed|pending")),
    ("zh", "definite-absent", listed("无|未见|未见明显|未发现|未及|不伴|否认|阴性|排除|已排除|正常|未见异常|无异常|不|非")),
    ("zh", "suspected", listed("考虑|考虑为|疑|疑似|可疑")),
    ("zh", "suggestive", ("提示",)),
    ("zh", "compatible", ("符合",)),
    ("zh", "favored", listed("倾向|倾向于")),
    ("zh", "possible", ("可能",)),
    ("zh", "to-be-excluded", listed("待排|待排除")),
    ("zh", "cannot-exclude", listed("不除外|不能除外")),
    ("zh", "pending-workup", ("待查",)),
    ("zh", "pending", ("性质待定",)),
    ("zh", "follow-up-advised", listed("随诊|建议复查")),
]
# Markers whose finding stands before them.
BEHIND = frozenset(listed("待排|待排除|待查|不除外|不能除外|性质待定|随诊"))

# Tokens of units by dimension; tokens that are a dimension of their own.
UNITS = {"mg": "mg|毫克", "g": "g|克", "mcg": "mcg|ug|µg|微克", "mL": "mL|ml|毫升", "L": "L|升", "IU": "IU|U|国际单位|单位", "mmol": "mmol|毫摩尔", "tablet": "片|tablet|tablets|tab|tabs", "capsule": "粒|capsule|capsules|cap|caps", "pill": "丸|pill|pills", "sachet": "袋", "ampoule": "支", "bottle": "瓶", "drop": "滴|drop|drops", "spray": "喷|spray|sprays", "patch": "贴|patch|patches", "mg/dL": "mg/dL", "mmol/L": "mmol/L", "ml/次": "ml/次", "mg/kg": "mg/kg", "毫克/公斤": "毫克/公斤"}
# Dimensions that are forms of a medicine.
FORMS = frozenset(listed("tablet|capsule|pill|sachet|ampoule|bottle|drop|spray|patch"))
# Tokens of frequencies.
FREQUENCIES = listed("QD|BID|TID|QID|QHS|QAM|QPM|QOD|Q4H|Q6H|Q8H|Q12H|PRN|STAT|AC|PC|PO|IV|IM|SC|SL|PR|PV|SUBQ|每日|每日一次|每日两次|每日三次|每日四次|一日一次|一日两次|一日三次|一日四次|每天|每次|每周|每周一次|每晚|睡前|晨起|空腹|饭前|饭后|餐前|餐后|饭中|必要时|需要时|顿服|隔日|隔日一次|每隔|口服|外用|肌注|静滴|静注|皮下注射|舌下含服|雾化|qd|bid|tid|prn")
# Frequencies by what they mean, in both languages.
CONCEPTS = [
    ("qd", "每日一次|一日一次|每天一次|每日|每天", "once daily|once a day|once per day|qd|q.d.|daily"),
    ("bid", "每日两次|一日两次|每天两次|每日二次", "twice daily|twice a day|two times daily|bid|b.i.d."),
    ("tid", "每日三次|一日三次|每天三次", "three times daily|three times a day|tid|t.i.d."),
    ("qid", "每日四次|一日四次|每天四次", "four times daily|four times a day|qid|q.i.d."),
    ("prn", "需要时|必要时|按需", "as needed|prn|p.r.n.|when needed"),
    ("qhs", "睡前|每晚", "at bedtime|nightly|qhs|at night"),
]

# Generic name, Chinese name, its sound, brands.
DRUGS = """metformin|二甲双胍|èr jiǎ shuāng guā|Glucophage|格华止
amlodipine|氨氯地平|ān lǜ dì píng|Norvasc|络活喜
atorvastatin|阿托伐他汀|ā tuō fá tā tīng|Lipitor|立普妥
aspirin|阿司匹林|ā sī pǐ lín|Bayer|拜阿司匹灵|拜阿司匹林
clopidogrel|氯吡格雷|lǜ bǐ gé léi|Plavix|波立维
metoprolol|美托洛尔|měi tuō luò ěr|Betaloc|Lopressor|倍他乐克
losartan|氯沙坦|lǜ shā tǎn|Cozaar|科素亚
enalapril|依那普利|yī nà pǔ lì|Vasotec|悦宁定
nifedipine|硝苯地平|xiāo běn dì píng|Adalat|拜新同|心痛定
glimepiride|格列美脲|gé liè měi niào|Amaryl|亚莫利
acarbose|阿卡波糖|ā kǎ bō táng|Glucobay|拜唐苹
insulin|胰岛素|yí dǎo sù|Lantus|Novolin|诺和灵|来得时
omeprazole|奥美拉唑|ào měi lā zuò|Prilosec|Losec|洛赛克
amoxicillin|阿莫西林|ā mò xī lín|Amoxil|阿莫仙
cephalexin|头孢氨苄|tóu bāo ān biàn|Keflex
azithromycin|阿奇霉素|ā qí méi sù|Zithromax|希舒美
levothyroxine|左甲状腺素|zuǒ jiǎ zhuàng xiàn sù|Euthyrox|优甲乐
ibuprofen|布洛芬|bù luò fēn|Advil|Motrin|芬必得
acetaminophen|对乙酰氨基酚|duì yǐ xiān ān jī fēn|Tylenol|泰诺|扑热息痛
warfarin|华法林|huá fǎ lín|Coumadin|可密定
prednisone|泼尼松|pō ní sōng|强的松"""
# Drugs that are looked for by substring alone: id, Chinese, English.
SUPPLEMENTAL = [("clonazepam", "氯硝西泮", "clonazepam"), ("clonidine", "可乐定", "clonidine"), ("trastuzumab-emtansine", "恩美曲妥珠单抗", "trastuzumab emtansine|trastuzumab-emtansine|t-dm1"), ("trastuzumab", "曲妥珠单抗", "trastuzumab")]
# Salts and releases of a drug: Chinese, English.
QUALIFIERS = [("琥珀酸", "succinate"), ("酒石酸", "tartrate"), ("马来酸", "maleate"), ("富马酸", "fumarate"), ("缓释", "extended-release|extended release|sustained-release|sustained release|er|xr|sr"), ("控释", "controlled-release|controlled release|cr")]
# What names of unknown drugs end in; words that make a clause one of medicines; verbs before a drug's name.
SUFFIXES = {"en": r"(?:olol|pril|sartan|statin|cillin|mycin|azole|pine|prazole|gliptin|formin|dipine)$", "zh": r"(?:唑|平|林|汀|坦|普利|胺|酮|砜|单抗|霉素|地平|沙坦)$"}
MEDICAL = {"en": r"\b(?:take|takes|taking|continue|continues|start|started|stop|stopped|prescribe|prescribed|give|given)\b", "zh": "服用|口服|继续用|停用|加用|改为"}
VERBS = "继续服用|继续用|停用|加用|改用|改为|口服|服用"

# Directives by language, kind and direction; those after a star need a medicine in their clause.
DIRECTIVES = [
    ("zh", "hold", None, "停药|停用|停服|停止服用|停止使用|停止服药|暂停服用|暂停用药|暂时停用|暂时停药|停药观察|逐渐停药|逐步停药|减停|撤药|撤停|禁用|禁服|忌服|中断用药|中断治疗|不要再吃|不要再服|不要再用|别吃了|别再吃|别用了|别服了|别再服了|先别服", "暂停|停掉|停了|先停|停|别吃|别服|别用|别再吃了|别再用了|不要吃|不要服|不要用|暂时不吃|暂时别吃|先别吃|先别用|停一停"),
    ("en", "hold", None, "hold off on|hold off|stop taking|stop using|do not take|don't take|do not use|discontinue|discontinued|withhold|cease taking|no longer take|quit taking", "hold|suspend|stop|skip|omit|pause|stay off|come off|leave off|lay off|keep off|get off|quit|take a break from|cut out|d/c|dc"),
    ("zh", "continue", None, "继续服用|继续用药|继续使用|继续吃|接着吃|续用|续服|维持治疗|维持原量|维持原剂量|按原剂量|恢复用药|恢复服用|恢复使用|恢复吃药|重新服用|坚持服用|坚持用药|规律服用|按时服用|长期服用|长期用药|维持原方案|继续原方案|照原方案|按原方案|按原样吃|按原样用|继续原剂量|照常服用|一直服|用药不变|方案不变", "继续|维持|照常吃|照常用|照常|一直吃|接着用|维持不变|照旧"),
    ("en", "continue", None, "continue taking|continue to take|keep taking|keep on taking|resume taking|remain on|stay on|carry on with", "continue|resume|keep using|maintain|keep on|stick with|stick to|carry on|stay the course"),
    ("zh", "dose-change", "down", "减量|减药|减少剂量|减半|半量|逐渐减量|缓慢减量|减小剂量", "减到|减至"),
    ("en", "dose-change", "down", "decrease|reduce|lower the dose|taper|halve|drop the dose|cut the dose", "wean off|wean|cut back|back off|step down|go down to|drop down to|drop to"),
    ("zh", "dose-change", "up", "加量|增量|增加剂量|加倍|逐渐加量|加大剂量", "加到|加至|增至|增到|翻倍|翻一倍"),
    ("en", "dose-change", "up", "increase|double the dose|up-titrate|increase the dose|up the dose|raise the dose|bump the dose|double up on", "step up|bump up|double the|go up to"),
    ("zh", "dose-change", "unknown", "调整剂量|剂量调整|调整用量", "调到"),
    ("en", "dose-change", "unknown", "adjust the dose|adjust your dose|titrate", ""),
]
# What turns a directive; what is watched rather than taken; what stands for a medicine.
INVERSIONS = {"zh": listed("不要|不可|不能|勿|切勿|别|无需|不用|不得"), "en": listed("do not|don't|never|no need to|avoid")}
MONITORED = listed("观察|随访|监测|复查|复诊|门诊")
REFERENTS = {"zh": listed("这个药|该药|此药|这药|这些药|这种药|该药物|原药"), "en": listed("this one|that one|this medication|the medication|your medication|this medicine|the medicine|this pill|the pill")}
CLASSES = {"zh": listed("降压药|降糖药|降脂药|调脂药|抗凝药|抗凝剂|抗血小板药|抗生素|消炎药|止痛药|镇痛药|安眠药|助眠药|激素|糖皮质激素|利尿药|利尿剂|平喘药|化疗药|止血药|抗病毒药|免疫抑制剂|他汀类|他汀|胰岛素类|中药|西药"), "en": listed("statin|statins|beta blocker|beta blockers|beta-blocker|ace inhibitor|ace inhibitors|arb|blood thinner|blood thinners|blood pressure pill|blood pressure pills|blood pressure medication|blood pressure medicine|blood pressure med|water pill|water pills|steroid|steroids|antibiotic|antibiotics|painkiller|painkillers|pain medication|diuretic|diuretics|inhaler")}

# Findings (name, Chinese, English, whether a wrong word of it is dangerous); places within the body.
FINDINGS = [("mass", "占位", "space-occupying|space occupying|mass", True), ("malignant", "恶性", "malignant|malignancy", True), ("metastasis", "转移", "metastasis|metastatic|metastases", False), ("nodule", "结节", "nodule|nodular", False), ("calcification", "钙化", "calcification|calcified", False), ("ild", "间质性肺病|间质性肺疾病", "interstitial lung disease|ild", False)]
LOCATORS = {"zh": listed("肝内|肺内|颅内|腹腔|盆腔|纵隔|胸腔|腹内"), "en": listed("intrahepatic|intrapulmonary|intracranial|intra-abdominal")}
# Hedges; words of exclusion; what holds such a word without excluding.
HEDGES = {"zh": listed("不能排除|不能除外|不除外|未能排除|不排除"), "en": listed("cannot exclude|cannot rule out|can't exclude|can't rule out")}
EXCLUSIONS = {"zh": listed("已排除|排除了|可排除|予以排除|排除|无"), "en": listed("excluded|ruled out|no evidence of|no evidence|negative for|无证据")}
NOT_EXCLUSIONS = {"zh": listed("不能排除|不排除|未能排除|未排除|难以排除"), "en": ()}
# Terms whose confusion is dangerous, in both languages.
HIGH_RISK = [("良性", "benign"), ("恶性", "malignant"), ("阳性", "positive"), ("阴性", "negative"), ("高血压", "hypertension"), ("低血压", "hypotension"), ("占位", "space-occupying lesion / mass"), ("待排", "to be excluded / rule out"), ("考虑", "consider / favor"), ("符合", "consistent with / compatible with"), ("提示", "suggestive of / indicates"), ("复查", "recheck / follow-up")]


def plain(sound: str) -> str:
    """Without the marks of tones."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", sound) if not "̀" <= c <= "ͯ"))


def drug_forms(rows: str) -> list[tuple[str, str]]:
    """(form, id) of each row: all names in lower case, once."""
    out: dict[tuple[str, str], None] = {}
    for row in rows.splitlines():
        generic, chinese, sound, *brands = listed(row)
        out |= {(form.lower(), generic.lower()): None for form in (generic, chinese, plain(sound), *brands)}
    return list(out)


@dataclass(frozen=True)
class Lexicon:
    """markers: (marker, language, polarity, strength, whether the finding stands before it); units: token to dimension;
    drugs: (form, id); directives: (marker, language, kind, direction, whether it needs a medicine)."""

    markers: tuple = field(default_factory=lambda: tuple((m, lang, "absent" if s == "definite-absent" else "uncertain", RANKS[s], m in BEHIND) for lang, s, ms in MARKERS for m in ms))
    units: dict = field(default_factory=lambda: {t: d for d, ts in UNITS.items() for t in listed(ts)})
    frequencies: tuple = FREQUENCIES
    drugs: tuple = field(default_factory=lambda: tuple(drug_forms(DRUGS)))
    directives: tuple = field(default_factory=lambda: tuple((m, lang, kind, way, scoped) for lang, kind, way, free, bound in DIRECTIVES for ms, scoped in ((free, False), (bound, True)) for m in listed(ms) if m))
    inversions: tuple = field(default_factory=lambda: tuple((m, lang) for lang, ms in INVERSIONS.items() for m in ms))
    monitored: tuple = MONITORED
    referents: tuple = field(default_factory=lambda: tuple((m, lang) for held in (REFERENTS, CLASSES) for lang, ms in held.items() for m in ms))
