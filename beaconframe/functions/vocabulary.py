"""The word lists and patterns that the rules need for right results. All of them are defaults of parameters."""

# News categories by title, in order; hints that name a category; the category of all else.
CATEGORY_RULES = (
    (r"詐騙|詐欺|車手|假投資|人頭帳戶|釣魚|解除分期|盜刷|博弈|洗錢|假交友|假檢警", "反詐"),
    (r"車禍|酒駕|毒駕|肇事|肇逃|超速|闖紅燈|追撞|翻車|撞死|撞傷|國道|機車|貨車|騎士", "交通"),
    (r"火警|火災|氣爆|爆炸|地震|颱風|豪雨|水災|淹水|山難|溺|搜救|消防|坍|土石|救護|受困", "災防"),
    (r"(?s)^(?!.*(?:失聯移工|命案|兇殺|凶殺|殺人|棄屍|通緝|騙)).*(?:失蹤|協尋|走失|尋人|失聯|迷航|迷途)", "協尋"),
)
HINTS = ("治安", "交通", "反詐", "災防", "資安", "食安", "衛生", "環境")
CATEGORY, CYBER = "治安", "資安"

# Risk of news.
HIGH = r"命案|兇殺|凶殺|殺人|殺害|砍人|砍殺|砍傷|持刀|刺死|刺傷|分屍|棄屍|槍擊|開槍|中彈|性侵|擄人|勒贖|劫|致死|身亡|死亡|喪命|溺斃|縱火|爆炸|氣爆|滅門"
MEDIUM = r"詐騙|詐欺|毒品|緝毒|販毒|竊|搶|強盜|酒駕|毒駕|肇逃|肇事|傷害|鬥毆|車禍|起訴|收押|羈押|逮捕|查獲|落網|火警|火災|墜|溺|走私|偷渡|賄|貪"
HIGH_EN = r"(?i)\b(murder|homicide|killed|dead|death|fatal|shooting|stabbing|explosion|kidnap\w*|rape|sexual assault|arson)\b"
MEDIUM_EN = r"(?i)\b(fraud|scam|drug|narcotic|arrest\w*|theft|robbery|burglar\w*|smuggl\w*|drunk driving|DUI|crash|fire|indict\w*|prosecut\w*|detain\w*|assault)\b"
CRITICAL = r"隨機殺人|無差別(?:殺人|砍人)|(?:氣爆|爆炸).*(?:[0-9０-９一二三四五六七八九十百兩]+\s*(?:死|亡)|死|亡|重傷)|(?:[0-9０-９]{2,}|[0-9０-９]{1,3}(?:[,，][0-9０-９]{3})+|[一二三四五六七八九兩幾數]*[十百千萬][一二三四五六七八九兩幾數十百千萬]*)\s*[餘多]?\s*(?:人|名)?\s*(?:死|亡|罹難|喪生|喪命|身亡)|(?:大量|重大|多人)(?:傷亡|死傷|死亡)|多人(?:罹難|喪命|身亡)|滅門|挾持.*人質|大規模.*(?:傷亡|死傷|死亡|爆炸|攻擊|砍人|殺人)"
NO_CASUALTY = r"(?:幸)?無(?:人)?傷亡|未(?:造成|傳出)?傷亡|無人(?:受傷|死亡|傷亡)"
HIGH_FLOOR = r"命案|兇殺|凶殺|殺人|殺害|不治|罹難|奪命|斃命|喪生|喪命|遇害|遇難|悶死|枉死|猝死|暴斃|刺殺|中刀|槍手|持槍|中槍|中彈|[1-9１-９]\s*(?:人|名)?\s*(?:死(?!角)|亡|罹難|喪生|喪命|身亡)|槍擊|開槍|槍械|彈藥|持刀.*(?:致死|死亡|身亡|喪命)|毒品.*(?:重案|大案|工廠|集團|走私|販運|製造)|緝毒.*(?:重案|大案)|販毒|製毒|海洛因|安非他命|愷他命"
ROUTINE = r"說明會|宣導|記者會|頒獎"
CYBER_ROUTINE = r"宣導|講座|說明會|研習|論壇|課程|競賽|駭客松|體驗營|防護(?:週|月|宣導)|資安月|徵才|開箱|評測|上市(?!櫃|上櫃|公司|企業)|個資保護(?:法)?|資安意識|防詐宣導"
CYBER_HIGH = r"勒索(?:病毒|軟體|攻擊)?|遭勒索|網攻|網路攻擊|(?:遭|被)?駭(?:客)?(?:入侵|攻擊|竊)|入侵.*(?:系統|主機|伺服器)|癱瘓.*(?:系統|服務|網路)|殭屍網路|供應鏈攻擊"
DATA_BREACH = r"個資外洩|資料外洩|個(?:人)?資(?:料)?.{0,6}(?:外洩|遭竊)|外洩.{0,6}個資|資料庫外洩|帳號(?:密碼)?外洩"
BREACH_SCALE = r"大規模|[0-9０-９]{2,}\s*萬|[0-9０-９]+\s*億|百萬|千萬|上億|數十萬|數百萬"
TOPIC_RISKS = {
    "食安": (r"餿水油|病死豬|食物中毒|致癌|致死|中毒", r"黑心|瘦肉精|農藥殘留|摻偽|偽藥|禁藥|下架|回收|查獲|走私|標示不實|逾期"),
    "衛生": (r"群聚感染|爆發|重症|死亡|院內感染", r"確診|群聚|隔離|傳染|染疫"),
    "環境": (r"毒物|外洩|重金屬|致癌|戴奧辛", r"偷排|廢水|污染|裁罰|廢棄物|棄置|盜採|濫墾"),
    "資安": (r"勒索|網攻|入侵|癱瘓|殭屍網路", r"駭客|個資|外洩|漏洞|釣魚|盜刷|木馬"),
}

# Calibration of foreign risks.
BUSINESS = ("金融", "其他")
CRISIS = r"戰爭|開戰|侵略|入侵|核[子武彈]|飛彈|轟炸|空襲|恐攻|恐怖攻擊|政變|宣戰|斷交|屠殺|種族清洗|大規模傷亡|大規模衝突|主權違約|債務違約|金融海嘯|系統性風險|罹難|死亡人數|重大傷亡|地震|海嘯|颶風|疫情爆發|大流行"

# Terms of official records, the first that is met counts.
POLICE_NEWS_TERMS = ((r"槍擊|爆裂物|炸彈|殺人|重大刑案|毒駕|販毒|製毒|羈押", "high"), (r"詐欺|毒品|查緝|查獲|竊盜|搶奪|強盜|婦幼|酒駕|攔阻", "medium"))
ASSEMBLY_TERMS = ((r"遊行|車隊|道路|封閉|管制", "medium"),)
ENFORCEMENT_TERMS = ((r"闖紅燈|酒駕|逆向|危險|人行道|紅燈", "medium"),)
COAST_GUARD_TERMS = (
    (r"宣教|宣導|講習|演練|研習|教育|座談", "low"), (r"死亡|罹難|失聯|翻覆|沉沒|偷渡|毒品|槍枝|槍械", "high"),
    (r"海警|襲擾|驅離|救援|救難|救溺|走私|緝獲|查獲|扣押|魚槍|海難", "medium"),
)
PHENOMENON_TERMS = ((r"超大豪雨|海嘯", "critical"), (r"大豪雨|豪雨|颱風", "high"), (r"大雨|強風|低溫|高溫", "medium"))
TRAVEL_TERMS = ((r"第四級|紅色", "critical"), (r"第三級|橙色", "high"), (r"第二級|黃色", "medium"), (r"第一級|灰色", "low"))
GRAVE_CHARGE = r"殺人|致死|無期徒刑|性自主|槍砲|強盜|擄人"
OFFICIAL_TYPES = ("gov-open-data", "cwa")
AGGREGATOR, AGGREGATOR_HOST = "Google News", "news.google.com"
GOVERNMENT_HOST = r"(?i)\.gov\.(?:tw|taipei)(?:[\s/?#:]|$)"

# Tags of an event's text.
LEXICON = (
    (r"詐騙|詐欺|車手|假投資|假交友|人頭帳戶|洗錢|假檢警|假冒|盜刷|釣魚", "詐欺"), (r"毒品|緝毒|販毒|製毒|安非他命|海洛因|大麻|愷他命|喪屍|依托咪酯|笑氣", "毒品"),
    (r"槍擊|槍枝|改造手槍|彈藥|子彈|開槍|中彈", "槍械"), (r"竊盜|失竊|偷竊|扒竊", "竊盜"), (r"搶奪|強盜|搶劫|擄|勒贖", "強盜擄人"), (r"砍人|持刀|刺死|刺傷|鬥毆|毆打|傷害", "暴力"),
    (r"命案|兇殺|凶殺|殺人|分屍|棄屍|陳屍|浮屍|遺體", "命案"), (r"性侵|性騷|猥褻|偷拍|性影像|性剝削", "性犯罪"), (r"家暴|家庭暴力|兒虐|虐童|虐待|跟蹤|跟騷", "家暴虐待"),
    (r"酒駕|毒駕|車禍|肇事|肇逃|追撞|翻車", "交通"), (r"火警|火災|氣爆|爆炸|爆裂|縱火", "火災"), (r"地震|規模.{0,3}地震|震度", "地震"), (r"颱風|豪雨|水災|淹水|土石|山崩", "天災"),
    (r"走私|偷渡|人口販運|人蛇", "走私偷渡"), (r"賭場|博弈|簽賭|賭博", "賭博"), (r"幫派|黑道|組織犯罪|掃黑|角頭", "幫派"), (r"貪污|收賄|圖利|掏空|背信|內線交易", "貪瀆"),
    (r"共諜|間諜|反滲透|認知作戰|統戰", "國安"), (r"失蹤|協尋|走失|失聯", "失蹤協尋"), (r"採購|決標|招標|標案|得標", "採購"), (r"起訴|偵辦|搜索|約談|羈押|收押|通緝|判刑|定讞|求刑", "司法"),
)

# Named entities, their leading particles, and what is too generic to be one.
ENTITY_PATTERNS = (r"[一-鿿]{2,4}分局", r"[一-鿿]{2,3}(?:地檢署|地方法院|高等法院)", r"[一-鿿]{2,3}(?:路|街|大道|夜市|車站|轉運站|機場|醫院|大學|國中|國小|園區)", r"KK園區|柬埔寨|緬甸|杜拜")
LEAD_PARTICLES = "在於到至向往從由並且也是與和的了對把被將為因經當且赴於"
GENERIC_ENTITY = r"^[臺台]灣$|^[一-鿿]{2,4}[縣市區鄉鎮]$|^[一-鿿]姓(?:男子|女子)?$|(?:地檢署|地方法院|高等法院|法院|地院|法務部)$"
GENERIC_ENTITIES = (
    "警方", "警察", "警局", "警政署", "刑事局", "消防局", "消防署", "海巡署", "移民署", "檢方", "檢警", "檢調", "法院", "地檢署", "地方法院", "高等法院", "調查局",
    "車手", "銀行", "超商", "LINE", "毒駕", "酒駕", "網路", "男子", "女子", "高雄市", "臺北市", "台北市", "新北市", "桃園市", "臺中市", "台中市", "臺南市", "台南市",
    "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "台東縣", "澎湖縣", "金門縣", "連江縣",
    "柬埔寨", "緬甸", "杜拜",
)
STOP_BIGRAMS = (
    "警方", "今天", "昨天", "記者", "報導", "新聞", "表示", "指出", "目前", "發生", "造成", "一名", "男子", "女子", "嫌犯", "涉嫌", "遭到", "進行", "結果", "如何",
    "詐騙", "詐欺", "匯款", "投資", "交友", "假投", "假交", "萬元", "百萬", "十萬",
)

# Regions that say nothing about a place.
VAGUE_REGIONS = ("全國", "未知", "", "—", "-")
ENTITY_BLOCKLIST = ("依托咪酯", "幼兒園")

# Impact domains in order, and what to do in each.
IMPACT_DOMAINS = (
    (r"資安|駭|個資|深偽|網軍|認知作戰", "帳號／系統"), (r"反詐|詐騙|洗錢|金融|投資|虛擬資產|銀行", "金流／帳戶"), (r"交通|車禍|肇逃|測速|道路|通行|酒駕", "通行"),
    (r"災防|天氣|地震|火警|氣爆|淹水|土石流|坍方|颱風|豪雨|工安", "安全／通行"), (r"食安|藥|醫|疾管|健康|中毒", "健康"), (r"地緣|外交|軍事|戰爭|衝突|主權|制裁|供應鏈", "外交／供應鏈"),
    (r"治安|命案|槍|刀|暴力|竊盜|搶奪|毒品|失蹤|協尋", "人身安全"),
)
NO_IMPACT = "一般注意"
DOMAIN_ACTIONS = (
    ("帳號／系統", "檢查帳號與系統曝險"), ("金流／帳戶", "避免匯款並核對來源"), ("通行", "查路況並改道"), ("安全／通行", "避開現場並追蹤警示"), ("健康", "確認接觸風險"),
    ("外交／供應鏈", "追蹤供應鏈與旅行風險"), ("人身安全", "提高警覺並避開熱點"),
)

# Relevance and noise of news.
POLICE = r"詐|車手|毒品|緝毒|販毒|製毒|安非他命|海洛因|大麻|愷他命|竊|偷|扒|搶|強盜|劫|侵占|命案|兇殺|凶殺|殺人|砍|刺|鬥毆|毆|傷害|施暴|槍|彈藥|爆裂|爆炸|氣爆|性侵|性騷|猥褻|偷拍|性影像|妨害|家暴|虐|跟蹤|跟騷|騷擾|恐嚇|脅迫|擄|勒贖|綁架|賭|博弈|簽賭|假球|娼|應召|嫖|幫派|黑道|圍事|角頭|走私|偷渡|人口販運|人蛇|洗錢|貪污|收賄|圖利|掏空|背信|內線|偽造|偽鈔|變造|假冒|冒用|盜刷|盜用|個資|駭客|勒索病毒|起訴|偵辦|偵查|搜索|約談|羈押|收押|交保|通緝|落網|到案|逮捕|查獲|破獲|查緝|查扣|移送|判刑|判決|定讞|求刑|犯|嫌|警方|員警|警察|捷警|鐵警|刑事|刑警|檢方|檢警|地檢|調查局|海巡|移民署|消防|救護|搜救|溺|墜|罹難|傷亡|死傷|身亡|致死|喪命|奪命|縱火|火警|火災|肇事|肇逃|酒駕|毒駕|車禍|事故|失蹤|協尋|尋回|走失|迷航|迷途|失聯|襲警|拒檢|拒捕|臨檪|臨檢|攔查|路檢|掃蕩|掃黑|肅竊|取締|落水|中毒|外洩|不法|違法|非法|犯罪|刑案|治安|報案|110|165"
POLICE_EN = r"(?i)\b(police|arrest\w*|fraud|scam|drug|narcotic|smuggl\w*|murder|homicide|kidnap\w*|robbery|theft|burglar\w*|assault|prosecut\w*|indict\w*|convict\w*|sentenc\w*|detain\w*|custody|wanted|gang|trafficking|launder\w*|bribe\w*|corruption|counterfeit|hack\w*|ransomware|phishing|crash|collision|drunk driving|DUI|blaze|explosion|rescue|drown\w*|manhunt|shooting|stabbing|crime|criminal|missing)\b"
DISASTER = r"土石流|坍方|走山|邊坡|落石|災情|警戒|撤離|疏散|避難|收容|淹水|積水|溢堤|潰堤|洪水|豪雨|暴雨|颱風|地震|餘震|海嘯|野火|停電|斷電|停水|路斷|封路|災害|災損|崩塌|坍塌|倒塌|殉職|受困|山難|海難|迷途|工安|職災|意外"
TOPICS = {
    "食安": r"黑心|食安|餿水油|病死豬|瘦肉精|農藥殘留|逾期|竄改|標示不實|下架|回收|查獲|違規|走私|摻偽|偽藥|禁藥|食物中毒|確診|疫情|撲殺",
    "衛生": r"疫情|群聚|確診|疫苗|傳染|染疫|食物中毒|中毒|院內感染|防疫|隔離",
    "環境": r"污染|廢水|偷排|裁罰|稽查|廢棄物|棄置|排放|空污|盜採|濫墾|噪音|毒物|外洩",
    "資安": r"資安|駭客|個資|外洩|漏洞|勒索|釣魚|盜刷|木馬|殭屍網路|網攻|入侵",
    "災防": f"{DISASTER}|{POLICE}",
}
LANDING_PAGE = r"查詢系統|管理資訊系統|資訊系統|資訊網站|全球資訊網|清冊|資料查詢"
CONTROL_SYSTEM = r"環保稽查處分管制系統"
EVENT_ACTION = r"駭客|(?:個資|資料)?外洩|攻擊|破獲|查獲|逮捕|落網|起訴|下架|回收|裁罰|偷排|食物中毒|群聚|確診|火警|車禍|命案|殺人|砍人|詐騙|盜用|盜刷|釣魚|冒用|毒品"
ENTERTAINMENT = r"劇透|劇情|懶人包|追劇|大結局|第\s*[0-9０-９]+(?:\s*[-–—~至到]\s*[0-9０-９]+)?\s*集|第\s*[一二三四五六七八九十百兩]+\s*集|分集劇情"
PRODUCTION = r"(?:新劇|新戲).{0,30}(?:演|拍攝|開拍|殺青)|(?:拍攝現場|粉絲圍觀).{0,20}(?:新劇|新戲|演員|藝人)"
WEAK_ENTERTAINMENT = r"線上看|預告片"
AIR_REFERENCE = r"(?i)(?:空氣品質指數|空氣品質).{0,12}(?:AQI|空氣污染)|\bAQI\b.{0,12}空氣污染"
FOREIGN_PLACE = r"委內瑞拉|巴基斯坦|俄羅斯|烏克蘭|基輔|莫斯科|緬甸(?!女|籍)|奈及利亞|法國|德國|英國|美國|加拿大|南韓|韓國(?!瑜)|首爾|日本|東京|大阪|印度(?!籍|男|女|妻|法商|移工)|以色列|加薩|巴勒斯坦|敘利亞|大馬士革|黎巴嫩|泰國(?!籍|進口|龍眼|神秘|航空|空服|箱屍)|曼谷|菲律賓|馬尼拉|印尼|雅加達|(?<!橫)越南(?!籍|移工|女|妻|同鄉)|河內|馬來西亞|新加坡|墨西哥|巴西|阿根廷|義大利|西班牙|葡萄牙|荷蘭|比利時|瑞士|瑞典|挪威|波蘭|希臘|土耳其|埃及|沙烏地|阿聯|伊朗|伊拉克|阿富汗|蘇丹|肯亞|南非|澳洲|紐西蘭|烏干達|剛果|衣索比亞|阿爾及利亞|摩洛哥|波斯尼亞|赤道幾內亞|摩爾多瓦|祕魯|秘魯|孟買|象牙海岸|丹佛"
HOME_MARKER = r"台灣|臺灣|中華民國|我國|本國|國內|國人|台商|臺商|僑(?:胞|民|界)|外交部|陸委會|僑委會|駐[^\s]{1,5}(?:代表處|辦事處|使館)|國防部|移民署|刑事局|警政署|內政部|國安局|調查局|檢調|食藥署|海巡署|海關|法務部|行政院|立法院|立院|立委|地檢署|台北|臺北|新北|桃園|台中|臺中|台南|臺南|高雄|基隆|新竹|苗栗|彰化|南投|雲林|嘉義|屏東|宜蘭|花蓮|台東|臺東|澎湖|金門|馬祖|連江|林口|二林|中正|兩岸|台男|臺男|台女|臺女|台版|臺版|台廠|臺廠|全台|全臺|台海|臺海|來台|來臺|在台|在臺|赴台|赴臺|返台|返臺|入台|入臺|台日|臺日|台美|臺美|台德|臺德|駐美|駐日|駐外|移工|外籍|新住民|美籍|英籍|澳籍|印尼籍|印度籍|越南籍|緬甸籍|泰籍|港人|印尼語|越南語|泰語|華語|青雲|是方電訊|美超微|黃國昌|四叉貓|郭正亮|奧丁丁|東京著衣|解放軍|共軍|中國(?:大陸)?[^，。；]{0,8}(?:試射|軍演|飛彈|航艦|航母|軍機|擾台|封鎖)"
HOME_NEGATED = r"與(?:台灣|臺灣)[^，。；、]{0,12}無(?:直接)?關聯|無(?:任何)?(?:台灣|臺灣)關聯|不只(?:台灣|臺灣)"
CYBER_EXEMPT = r"(?i)資安|個資|資料.{0,6}外洩|漏洞|駭客|網攻|網路犯罪|勒索|CVE"
FOREIGN_CONTEXT = r"強震|地震|餘震|野火|森林大火|山火|林火|熱浪|颶風|龍捲風|洪水|水災|土石流|火山|海嘯|乾旱|暴雪|寒流|內戰|戰爭|開戰|停火|空襲|飛彈|導彈|無人機|砲擊|恐攻|恐怖攻擊|爆炸案|炸彈客|自殺炸彈|政變|叛軍|交火|流血衝突|墜谷|墜崖|墜機|空難|沉船|船難|成災|(?:[0-9０-９]{2,}|千|萬|多人|大量|數十|數百)\s*[餘多]?\s*人?\s*(?:死|亡|傷|罹難|喪生|喪命)"
IMMIGRATION_SOURCE = r"移民署|移民新聞|新住民全球新聞網"
IMMIGRATION_LIFESTYLE = r"百人百聲|TWAC|文化交流|文化體驗|文化鵲橋|七夕|職涯|親子活動|親子連結|體驗營|課程|講座|宣導|說明會|報名|抽獎|好禮|得獎名單|表揚|頒獎|影音新聞|廉政動畫|療癒|暢談|扎根|便民|填報|申報|樂園|音樂祭|能力升級|數位資訊|服務站|人道關懷"
IMMIGRATION_ENFORCEMENT = r"查獲|查緝|查察|破獲|逮捕|拘提|搜索|移送|偵辦|起訴|判刑|收押|羈押|通緝|攔截|截獲|攔阻|瓦解|尋回|救出|救援|裁處|遣返|驅逐|偷渡|非法入境|逾期居留|失聯移工|人口販運|人蛇|假結婚|偽造證件|性剝削|勞力剝削"
POLITICAL_CONTEXT = r"總統|總統府|行政院|中央|市府|縣府|立法院|立院|議會|立委|議員|市長|縣長|候選人|政黨|國民黨|民進黨|民眾黨|白營|藍營|綠營|藍綠|朝野|政治|施政|食安會|缺席|藍(?=籲|批|嗆)|綠(?=籲|批|嗆|稱)"
POLITICAL_RHETORIC = r"互嗆|喊話|喊|嗆|號召|抗議|批評|反擊|缺席|口水|杯葛|造勢|政治秀|政治責任|檢討|轟|酸"
PURE_POLITICS = r"號召.{0,8}上街|選舉|罷免|民調|政黨攻防|藍綠互批|朝野攻防"
CRIMINAL_PROCEEDING = r"查獲|查緝|破獲|逮捕|拘提|搜索|移送|偵辦|偵查|起訴|羈押|收押|交保|判刑|判決|定讞|通緝|報案|涉嫌|涉案|被控|拒捕|襲警|詐騙|詐欺|貪污|收賄|行賄|圖利|洗錢|偽造|共諜|洩密|暴力|恐嚇|性騷|性侵|命案|殺人|砍(?:人|傷|死)|刺(?:人|傷|死)|虐童|兒虐|虐待|毒品|槍擊|竊盜|搶劫|酒駕|肇事|車禍|火災|爆炸|人口販運|食物中毒|偷排|裁罰|裁處|稽查"
OUTREACH = r"(?:反詐|防詐).{0,24}(?:宣導|宣傳|講習|聯名)|(?:宣導|宣傳|講習|聯名).{0,24}(?:反詐|防詐)"

# Datasets that are lists rather than events.
REFERENCE_DATASETS = (
    "13908", "13166", "176610", "12197", "136123", "169080", "146885", "167814", "171164", "171167", "176021", "78638", "155895", "171349", "172940", "157949", "151006", "173142",
    "146936", "143467", "28178", "129136", "25940", "13228", "70930", "39331", "134922", "ly-bills", "tad-index-inbound-lastmonth", "84049", "124173", "11598", "123349",
)
