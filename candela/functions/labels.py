"""Vietnamese wording of the labels, as columns beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The wording of each label.
WORDING = {
    "strong_bullish": "tích cực rõ rệt",
    "moderate_bullish": "tích cực vừa phải",
    "lean_bullish": "hơi nghiêng tích cực",
    "weak_bullish": "tích cực yếu",
    "bullish": "tích cực",
    "strong_bearish": "tiêu cực rõ rệt",
    "moderate_bearish": "tiêu cực vừa phải",
    "lean_bearish": "hơi nghiêng tiêu cực",
    "weak_bearish": "tiêu cực yếu",
    "bearish": "tiêu cực",
    "neutral": "trung tính",
    "transitional": "chuyển tiếp",
    "aligned_uptrend": "xu hướng tăng đồng thuận (giá trên SMA20 trên SMA50 trên SMA200)",
    "aligned_downtrend": "xu hướng giảm đồng thuận (giá dưới SMA20 dưới SMA50 dưới SMA200)",
    "above_sma200_transitional": "đã vượt lên trên đường trung bình 200 phiên",
    "below_sma200_transitional": "vẫn nằm dưới đường trung bình 200 phiên",
    "short_term_uptrend": "xu hướng tăng ngắn hạn",
    "short_term_downtrend": "xu hướng giảm ngắn hạn",
    "strongly_bullish": "tích cực mạnh",
    "strongly_bearish": "tiêu cực mạnh",
    "rising": "đang đi lên",
    "falling": "đang đi xuống",
    "flat": "đi ngang",
    "buy_side": "bên mua chiếm ưu thế",
    "sell_side": "bên bán chiếm ưu thế",
    "balanced": "cân bằng",
    "overbought": "vùng quá mua",
    "oversold": "vùng quá bán",
    "near_high": "sát đỉnh biên độ gần nhất",
    "near_low": "sát đáy biên độ gần nhất",
    "middle": "ở giữa biên độ",
    "up": "tăng",
    "down": "giảm",
    "very_high": "rất cao",
    "elevated": "cao hơn bình thường",
    "very_low": "rất thấp",
    "low": "thấp hơn bình thường",
    "normal": "bình thường",
    "net_buying": "mua ròng",
    "net_selling": "bán ròng",
    "above_upper": "nằm trên dải trên",
    "below_lower": "nằm dưới dải dưới",
    "inside": "nằm trong dải",
    "bullish_cross": "cắt tăng",
    "bearish_cross": "cắt giảm",
    "none": "không có tín hiệu giao cắt",
    "extended": "kéo dài đáng chú ý",
    "notable": "đáng chú ý",
    "strong_uptrend": "tăng mạnh",
    "strong_downtrend": "giảm mạnh",
}
#: The wording of true and false for columns of that name.
SWITCHES = {"squeeze": ("dải Bollinger đang co hẹp", "dải Bollinger nới rộng bình thường")}


def with_wording(df: DataFrame, suffix: str = "_vi") -> DataFrame:
    """Beside each text column and each boolean one in SWITCHES its wording; null where a value has none.

    Identifiers (ticker, exchange) get none, nor does a column whose name ends in the suffix.
    """
    words = F.create_map(*[F.lit(x) for pair in WORDING.items() for x in pair])
    new = {}
    for name, kind in df.dtypes:
        if kind == "string" and name not in ("ticker", "exchange") and not name.endswith(suffix):
            new[name + suffix] = F.try_element_at(words, F.col(name))
        elif kind == "boolean" and name in SWITCHES:
            yes, no = SWITCHES[name]
            new[name + suffix] = F.when(F.col(name), yes).when(~F.col(name), no)
    return df.withColumns(new)
