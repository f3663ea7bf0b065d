"""Token counts, chunking, windows of chunks, tail rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings
from millrace.functions.batches import pieces
from millrace.functions.draws import pick, uniform
from millrace.operators.base import Operator, register

SEPARATORS = ("\n\n", "\n", "。", ".")
SENTENCE = r"[\n.;:?!。！？]"
_WORDS = re.compile(r"[㐀-鿿豈-﫿]|(?:(?![㐀-鿿豈-﫿])\w)+|[^\s\w]")


class Tokenizer:
    """Tokens of a text: by the built-in rule (words, single Han signs, other signs), or by a file: a JSON vocabulary
    of the `tokenizers` library or a SentencePiece .model. The file must be readable on every executor."""

    def __init__(self, path: str | None = None):
        self.path, self._loaded = path, None

    def __getstate__(self):
        return {"path": self.path, "_loaded": None}

    def __call__(self, text: str) -> list[str]:
        if not self.path:
            return _WORDS.findall(text)
        if self._loaded is None:
            self._loaded = self._load()
        return self._loaded(text)

    def _load(self) -> Callable[[str], list[str]]:
        if self.path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda t: sp.encode(t, out_type=str)
        from tokenizers import Tokenizer as Fast

        t = Fast.from_file(self.path)
        return lambda text: t.encode(text, add_special_tokens=False).tokens

    def length(self, text: str) -> int:
        return len(self(text))


def map_text(f: Callable[[str], object], kind: str):
    """A column function that applies f to every non-null text, in pieces of Arrow batches."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches):
            yield pa.array([None if t is None else f(t) for t in b.to_pylist()], _ARROW[kind])

    return run


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "double": pa.float64()}


@register()
class TokenCounter(Operator):
    """The number of tokens of `text_col` and, if `tokenized_col` is named, the tokens. The built-in tokenizer stays in the JVM."""

    def setup(self, text_col: str = "text", tokenizer_path: str | None = None, output_col: str = "token_count", tokenized_col: str | None = None):
        self.text, self.out, self.tokens, self.path = text_col, output_col, tokenized_col, tokenizer_path

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.path:
            if self.tokens:
                df = df.withColumn(self.tokens, strings.tokens(F.col(self.text)))
            return df.withColumn(self.out, F.size(F.col(self.tokens) if self.tokens else strings.tokens(F.col(self.text))))
        t = Tokenizer(self.path)
        if self.tokens:
            df = df.withColumn(self.tokens, map_text(t, "array<string>")(F.col(self.text)))
            return df.withColumn(self.out, F.size(self.tokens))
        return df.withColumn(self.out, map_text(t.length, "int")(F.col(self.text)))


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int], separators=SEPARATORS) -> list[str]:
    """Chunks of at most `size` tokens where separators allow, in order, with up to `overlap` tokens in common.

    The text is cut before the first separator of the list that it contains; pieces that are too long are cut again by
    the later ones; neighbouring pieces are joined as long as they fit. Chunks have no white space at their ends.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        pieces, later = [text], ()
    elif separators[at] == "":
        pieces, later = list(text), ()
    else:
        sep, later = separators[at], separators[at + 1 :]
        head, *rest = text.split(sep)
        pieces = [p for p in (head, *(sep + r for r in rest)) if p]
    out: list[str] = []
    run: list[tuple[str, int]] = []

    def close(keep: int):
        if run:
            joined = "".join(p for p, _ in run).strip()
            if joined:
                out.append(joined)
        while run and (sum(n for _, n in run) > keep):
            run.pop(0)

    for p in pieces:
        n = length(p)
        if n >= size and (later or n > size):
            close(0)
            out += recursive_split(p, size, overlap, length, later) if later else [p.strip()] if p.strip() else []
            continue
        if run and sum(m for _, m in run) + n > size:
            close(overlap)
            while run and sum(m for _, m in run) + n > size:
                run.pop(0)
        run.append((p, n))
    close(0)
    return out


@register("TextSplitter")
class TextSplit(Operator):
    """Chunks of `text_col` as an array. With several chunk sizes, size and overlap are drawn independently for each row."""

    def setup(self, text_col: str = "text", output_col: str = "text_list", tokenizer_path: str | None = None, chunk_size=1000, chunk_overlap=200, separators=None, id_col: str = "hash_id", seed: int = 0):
        self.text, self.out, self.id, self.seed = text_col, output_col, id_col, seed
        self.sizes = list(chunk_size) if isinstance(chunk_size, (list, tuple)) else [chunk_size]
        self.overlaps = list(chunk_overlap) if isinstance(chunk_overlap, (list, tuple)) else [chunk_overlap]
        self.tokenizer, self.separators = Tokenizer(tokenizer_path), tuple(separators or SEPARATORS)

    def apply(self, df: DataFrame) -> DataFrame:
        t, seps = self.tokenizer, self.separators

        @F.arrow_udf("array<string>")
        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, sizes, overlaps in pieces(batches):
                yield pa.array([None if x is None else recursive_split(x, n, o, t.length, seps) for x, n, o in zip(texts.to_pylist(), sizes.to_pylist(), overlaps.to_pylist())], pa.list_(pa.string()))

        if len(self.sizes) > 1:
            size, overlap = (F.element_at(F.array(*map(F.lit, v)), pick(uniform(F.col(self.id), name, 0, self.seed), [1.0] * len(v)) + 1) for name, v in (("size", self.sizes), ("overlap", self.overlaps)))
        else:
            size, overlap = F.lit(self.sizes[0]), F.lit(self.overlaps[0])
        return df.withColumn(self.out, run(F.col(self.text), size, overlap))


def sentences(c: Column, pattern: str = SENTENCE, longer_than: int = 10) -> Column:
    """Sentences without white space at their ends and longer than `longer_than` signs."""
    return F.filter(F.transform(F.split(c, pattern), strings.strip), lambda s: F.length(s) > longer_than)


def pair_chunks(chunks: Column) -> Column:
    """Each chunk with the next one behind it, the last one alone."""
    return window_chunks(chunks, 2)


def window_chunks(chunks: Column, width: int) -> Column:
    """From each chunk on, `width` chunks in one; fewer at the end. An empty array stays so."""
    n = F.size(chunks)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(chunks, i, width), ""))).otherwise(F.array().cast("array<string>"))


def few_ellipses(c: Column, most: int = 4) -> Column:
    """Whether at most `most` ellipses of three dots are in the text."""
    return strings.count_of(c, "...") <= most


@register()
class EllipsisFilter(Operator):
    def setup(self, text_col: str = "text", most: int = 4):
        self.text, self.most = text_col, most

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(few_ellipses(F.col(self.text), self.most))


def trim_tail(text: str, min_tokens: int, length: Callable[[str], int]) -> str:
    """Without short last lines: from the end on, a line of at most `min_tokens` tokens, or one that ends in an ellipsis,
    is taken out wherever it occurs, until one stays. Three and more newlines become two."""
    lines = [x for x in text.split("\n") if x.strip()]
    for line in reversed(lines):
        if length(line) <= min_tokens or line.rstrip().endswith(("...", "…")):
            text = text.replace(line, "")
        else:
            break
    return re.sub(r"\n{3,}", "\n\n", text)


@register()
class TailTrim(Operator):
    def setup(self, text_col: str = "text", output_col: str | None = None, min_tail_line_length: int = 10, tokenizer_path: str | None = None):
        self.text, self.out, self.n, self.tokenizer = text_col, output_col or text_col, min_tail_line_length, Tokenizer(tokenizer_path)

    def apply(self, df: DataFrame) -> DataFrame:
        n, t = self.n, self.tokenizer
        return df.withColumn(self.out, map_text(lambda x: trim_tail(x, n, t.length), "string")(F.col(self.text)))


#: Traditional signs and their simplified forms, by the side of each other: the common ones whose simplified form isn't
#: written in traditional texts. Single signs only.
TRADITIONAL = (
    "說話時間國學會來們體點開關書見問過還發經頭電車長門馬鳥魚風龍氣愛樂灣讓認識實現對兩進動種業價鯨這為無當樣產機應該難題變歡觀覺聽聲買賣錢銀鐵鋼錯鏡張強彈場塊報壓壞壽夢奪奮婦媽嬰孫寧審寫寶將專尋導屬嶺島嚴"
    "歲幣帶幫廢廳彎徑憂懷態憑慣慶戰戲戶擁擇擊擔擴攝撥攔敗敵數斷舊暫曆曉條極構槍標樓樹橋檔檢權殺毀歷歸殘決沒況漢溝滅滿漁潔濟濃濕灑灘災烏熱燈燒營爭爺爾牆獎獨獲獻獸環瑪畝畢畫異療瘋盡監盤盧眾矯碼礎禮禍穩窮競筆"
    "節築簡籃籌籠糧糾紀約紅紋納純紙級紛細紹終組結絕絡給統絲綠維緊緒線緣編緩練縣縮總績織繞繪繳續罰罷羅義習聖聞聯聰職肅腦腳腸膚膽臉臨舉艦艱藝華蓋蔣蕭薩藍藥蘇蘭處虛號蝦衛補裝褲襲規視親覽觸計訂訊討訓記訪設許訴"
    "診評詞試詩詳誤誰課調談請論諸諾謀謂謊講謝譜譯議護讀貓貝負財貢貧貨販貪責貴貸費貿賀資賊賓賞賠賢賬質賴賺購賽贈贏趕趙趨踐躍軍軌軟較載輔輕輛輝輪輯輸轉轟辦辭農邊遠運達違遙遞遲遷選遺邁郵鄉鄰鄭醫醬釋針釣鈴鉛銅"
    "銘銷鋪鋒鋸錄錦鍋鍵鎖鎮鏈鑽閃閉閱闊闖隊階際陣陸陽陰險隨隱雖雙雞離雜霧靈靜響頁頂項順預頑頓領頻顆顏願顧顯類飄飛飯飲飽飾餅養餓館駐駕駛騎騙騷驅驗驚驢髒鬧鮮鳳鳴鴨鵝鷹麗麥黃齊齒龜傳傷備債傾億優償儲內冊凍凱則"
    "剛創劇劍劑勁勞勢勵勸匯區協單卻厲參吳呂員啞啟喪喬嘆嘗嗎囑圍園圓圖團執堅堯塵墊墳壯夠奧妝姦娛嬌寢"
)
SIMPLIFIED = (
    "说话时间国学会来们体点开关书见问过还发经头电车长门马鸟鱼风龙气爱乐湾让认识实现对两进动种业价鲸这为无当样产机应该难题变欢观觉听声买卖钱银铁钢错镜张强弹场块报压坏寿梦夺奋妇妈婴孙宁审写宝将专寻导属岭岛严"
    "岁币带帮废厅弯径忧怀态凭惯庆战戏户拥择击担扩摄拨拦败敌数断旧暂历晓条极构枪标楼树桥档检权杀毁历归残决没况汉沟灭满渔洁济浓湿洒滩灾乌热灯烧营争爷尔墙奖独获献兽环玛亩毕画异疗疯尽监盘卢众矫码础礼祸稳穷竞笔"
    "节筑简篮筹笼粮纠纪约红纹纳纯纸级纷细绍终组结绝络给统丝绿维紧绪线缘编缓练县缩总绩织绕绘缴续罚罢罗义习圣闻联聪职肃脑脚肠肤胆脸临举舰艰艺华盖蒋萧萨蓝药苏兰处虚号虾卫补装裤袭规视亲览触计订讯讨训记访设许诉"
    "诊评词试诗详误谁课调谈请论诸诺谋谓谎讲谢谱译议护读猫贝负财贡贫货贩贪责贵贷费贸贺资贼宾赏赔贤账质赖赚购赛赠赢赶赵趋践跃军轨软较载辅轻辆辉轮辑输转轰办辞农边远运达违遥递迟迁选遗迈邮乡邻郑医酱释针钓铃铅铜"
    "铭销铺锋锯录锦锅键锁镇链钻闪闭阅阔闯队阶际阵陆阳阴险随隐虽双鸡离杂雾灵静响页顶项顺预顽顿领频颗颜愿顾显类飘飞饭饮饱饰饼养饿馆驻驾驶骑骗骚驱验惊驴脏闹鲜凤鸣鸭鹅鹰丽麦黄齐齿龟传伤备债倾亿优偿储内册冻凯则"
    "刚创剧剑剂劲劳势励劝汇区协单却厉参吴吕员哑启丧乔叹尝吗嘱围园圆图团执坚尧尘垫坟壮够奥妆奸娱娇寝"
)
#: Signs that both writings use, but for which simplified writing also puts them: replaced, but no sign of simplified writing.
_SHARED_FROM, _SHARED_TO = "個從與麼鐘廠廣復據於煙範網莊萬葉蟲術衝註誇誌證讚豐跡適閒須餘鬆鬱黨兒兇劃勝嚇", "个从与么钟厂广复据于烟范网庄万叶虫术冲注夸志证赞丰迹适闲须余松郁党儿凶划胜吓"


def to_simplified(c: Column) -> Column:
    return F.translate(c, TRADITIONAL + _SHARED_FROM, SIMPLIFIED + _SHARED_TO)


@register()
class JsonReply(Operator):
    """Parse a model's JSON answer in `text_col`: as variant, or as `schema` (DDL). Null where it doesn't parse."""

    def setup(self, text_col: str, output_col: str | None = None, schema: str | None = None):
        self.text, self.out, self.schema = text_col, output_col or text_col, schema

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, strings.json_reply(F.col(self.text), self.schema))
