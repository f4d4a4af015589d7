"""DuckDB oracle texts, one per query key.

The fixture mapping is written here a second time, in SQL, independent of
the DataFrame code in ``sources/driver.py``. Money stays exact (decimal or
integer cents); every ratio is the same single IEEE multiply-then-divide as
on the Spark side; means are summed in decimal on both sides.
"""

from __future__ import annotations


def ratio(num: str, den: str, scale: str = "1.0") -> str:
    return (f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) * {scale} "
            f"/ CAST({den} AS DOUBLE) END")


def money_sum(x: str) -> str:
    return f"CAST(COALESCE(SUM({x}), 0) AS DECIMAL(38,2))"


def cents_to(x: str, p: int = 12) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,0)) * 0.01 AS DECIMAL({p},2))"


def price_sql(mrp: str, disc: str) -> str:
    """Half-up cents of MRP × (100 − discount%) / 100, in integers."""
    return cents_to(f"(CAST({mrp} * 100 AS BIGINT) * CAST((100 - {disc}) * 100 AS BIGINT) + 5000) // 10000")


def _recalc(src: str, touched: str = "TRUE") -> str:
    """W5 over ``src`` (ad columns); only rows where ``touched`` holds change."""
    return f"""
    SELECT a.AdID, a.CampaignID, a.AdName, a.Impressions, a.Clicks,
      CASE WHEN {touched} THEN
        CASE WHEN COALESCE(cc.cc, 0) > 0 AND a.Clicks > 0
             THEN {ratio('COALESCE(co.co, 0)', 'cc.cc')} ELSE 0.0 END
      ELSE a.ConversionRate END AS ConversionRate,
      a.CostPerAd,
      CASE WHEN {touched} THEN
        CASE WHEN COALESCE(cc.cc, 0) > 0
             THEN {cents_to("a.floor_share + CASE WHEN a.place = 1 THEN COALESCE(co.rc, 0) - cc.floors ELSE 0 END", 18)}
             ELSE CAST(0 AS DECIMAL(18,2)) END
      ELSE a.AttributedRevenue END AS AttributedRevenue
    FROM (SELECT x.*, ROW_NUMBER() OVER (PARTITION BY x.CampaignID ORDER BY x.Clicks DESC, x.AdID) AS place,
                 CASE WHEN t.cc > 0 THEN COALESCE(o.rc, 0) * x.Clicks // t.cc ELSE 0 END AS floor_share
          FROM {src} x
          LEFT JOIN (SELECT CampaignID, SUM(Clicks) AS cc FROM {src} GROUP BY CampaignID) t
            ON t.CampaignID = x.CampaignID
          LEFT JOIN m_camp_orders o ON o.CampaignID = x.CampaignID) a
    LEFT JOIN (SELECT y.CampaignID, SUM(y.Clicks) AS cc,
                      SUM(CASE WHEN z.cc > 0 THEN COALESCE(o2.rc, 0) * y.Clicks // z.cc ELSE 0 END) AS floors
               FROM {src} y
               JOIN (SELECT CampaignID, SUM(Clicks) AS cc FROM {src} GROUP BY CampaignID) z
                 ON z.CampaignID = y.CampaignID
               LEFT JOIN m_camp_orders o2 ON o2.CampaignID = y.CampaignID
               GROUP BY y.CampaignID) cc
      ON cc.CampaignID = a.CampaignID
    LEFT JOIN m_camp_orders co ON co.CampaignID = a.CampaignID"""


def _segment_case(idx: int) -> str:
    from ..sources.driver import SEGMENT_PROFILE
    whens = " ".join(f"WHEN '{k}' THEN '{v[idx]}'" for k, v in SEGMENT_PROFILE.items())
    return f"CASE SegmentName {whens} ELSE 'Unknown' END"


def _model(ledger: str = "spent") -> list[tuple[str, str]]:
    from ..sources.driver import OBJECTIVES
    objective = "CASE s.s_suppkey % 4 " + " ".join(
        f"WHEN {i} THEN '{o}'" for i, o in enumerate(OBJECTIVES)) + " END"
    current = "COALESCE(a.spent, 0)" if ledger == "spent" else "0"
    return [
        ("m_k", "SELECT COUNT(*) AS k FROM supplier"),
        ("m_platform", "SELECT CAST(n_nationkey AS BIGINT) AS PlatformID, n_name AS PlatformName FROM nation"),
        ("m_region", "SELECT CAST(r_regionkey AS BIGINT) AS RegionID, r_name AS RegionName FROM region"),
        ("m_segment", f"""
            SELECT CAST(DENSE_RANK() OVER (ORDER BY SegmentName) AS BIGINT) AS SegmentID, SegmentName,
                   {_segment_case(0)} AS AgeGroup, {_segment_case(1)} AS IncomeCategory
            FROM (SELECT DISTINCT c_mktsegment AS SegmentName FROM customer) d"""),
        ("m_customer", """
            SELECT c.c_custkey AS CustomerID, s.SegmentID, CAST(n.n_regionkey AS BIGINT) AS RegionID
            FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
            LEFT JOIN m_segment s ON s.SegmentName = c.c_mktsegment"""),
        ("m_product", """
            SELECT p_partkey AS ProductID, p_name AS ProductName,
                   CAST(p_retailprice AS DECIMAL(12,2)) AS MRP FROM part"""),
        ("m_li_part", """
            SELECT l_partkey, SUM(l_quantity) AS q, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r
            FROM lineitem GROUP BY l_partkey"""),
        ("m_ad0", f"""
            SELECT p.p_partkey AS AdID, p.p_partkey % (SELECT k FROM m_k) AS CampaignID, p.p_name AS AdName,
                   CAST(CASE WHEN p.p_partkey % 101 = 0 THEN 0 ELSE COALESCE(li.q, 0) END AS BIGINT) AS Impressions,
                   CAST(CASE WHEN p.p_partkey % 101 = 0 THEN 0 ELSE COALESCE(li.r, 0) END AS BIGINT) AS Clicks,
                   0.0::DOUBLE AS ConversionRate,
                   {cents_to('CASE WHEN p.p_partkey % 97 = 0 THEN 0 ELSE CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) * p.p_size // 10 END')} AS CostPerAd,
                   CAST(0 AS DECIMAL(18,2)) AS AttributedRevenue
            FROM part p LEFT JOIN m_li_part li ON li.l_partkey = p.p_partkey"""),
        ("m_campaign", f"""
            SELECT s.s_suppkey AS CampaignID, CAST(s.s_nationkey AS BIGINT) AS PlatformID,
                   CAST(DATE '2001-05-01' + CAST(s.s_suppkey % 60 AS INTEGER) AS DATE) AS StartDate,
                   CAST(DATE '2001-07-01' + CAST((s.s_suppkey * 11) % 60 AS INTEGER) AS DATE) AS EndDate,
                   {cents_to('CASE WHEN s.s_suppkey % 50 = 9 THEN 0 ELSE COALESCE(a.cents, 0) * (60 + s.s_suppkey % 80) // 100 END', 14)} AS Budget,
                   CAST({current} AS DECIMAL(14,2)) AS CurrentBudget,
                   {objective} AS Objective
            FROM supplier s LEFT JOIN (
              SELECT CampaignID, SUM(CAST(CostPerAd * 100 AS BIGINT)) AS cents, SUM(CostPerAd) AS spent
              FROM m_ad0 GROUP BY CampaignID) a ON a.CampaignID = s.s_suppkey"""),
        ("m_orders", """
            SELECT o_orderkey AS OrderID, o_custkey AS CustomerID,
                   CASE WHEN o_orderkey % 11 = 0 OR ((o_orderkey * 7 + o_custkey) % (SELECT k FROM m_k)) % 10 = 3
                        THEN NULL ELSE (o_orderkey * 7 + o_custkey) % (SELECT k FROM m_k) END AS CampaignID,
                   CAST(o_totalprice AS DECIMAL(12,2)) AS TotalAmount
            FROM orders"""),
        ("m_camp_orders", """
            SELECT CampaignID, COUNT(*) AS co, CAST(SUM(TotalAmount) * 100 AS HUGEINT) AS rc
            FROM m_orders WHERE CampaignID IS NOT NULL GROUP BY CampaignID"""),
        ("m_ad", _recalc("m_ad0")),
        ("m_cp0", """
            SELECT l_suppkey AS CampaignID, l_partkey AS ProductID,
                   CAST(MAX(CAST(l_discount AS DECIMAL(4,2))) * 100 AS DECIMAL(5,2)) AS Discount
            FROM lineitem GROUP BY l_suppkey, l_partkey"""),
        ("m_cp", f"""
            SELECT cp.CampaignID, cp.ProductID, cp.Discount, {price_sql('p.MRP', 'cp.Discount')} AS SellingPrice
            FROM m_cp0 cp JOIN m_product p ON p.ProductID = cp.ProductID"""),
        ("m_order_line", """
            SELECT l_orderkey AS OrderID, l_partkey AS ProductID,
                   CAST(l_extendedprice AS DECIMAL(12,2)) AS Price, CAST(l_discount AS DECIMAL(4,2)) AS Discount
            FROM lineitem"""),
    ]


def _with(body: str, extra: list[tuple[str, str]] | None = None, ledger: str = "spent",
          recursive: bool = False) -> str:
    ctes = _model(ledger) + (extra or [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


# --- views ------------------------------------------------------------------------

V1 = f"""SELECT AdID, AdName, CampaignID, {ratio('Clicks', 'Impressions', '100.0')} AS CTR, ConversionRate,
  {ratio('CostPerAd', 'Clicks')} AS CostPerClick, {ratio('AttributedRevenue', 'CostPerAd')} AS ROAS,
  AttributedRevenue, CostPerAd FROM m_ad"""

CFACTS = [("m_cfacts", f"""
    SELECT c.CampaignID, c.PlatformID, p.PlatformName, c.Objective, c.Budget,
      CAST(COALESCE(a.spend, 0) AS DECIMAL(38,2)) AS TotalSpend,
      CAST(COALESCE(o.rev, 0) AS DECIMAL(38,2)) AS ActualOrderRevenue,
      CAST(COALESCE(a.n, 0) AS BIGINT) AS NumAds, CAST(COALESCE(o.n, 0) AS BIGINT) AS TotalOrders,
      CAST(COALESCE(a.clk, 0) AS BIGINT) AS Clicks, CAST(COALESCE(a.imp, 0) AS BIGINT) AS Impressions
    FROM m_campaign c
    LEFT JOIN m_platform p ON p.PlatformID = c.PlatformID
    LEFT JOIN (SELECT CampaignID, {money_sum('CostPerAd')} AS spend, COUNT(AdID) AS n,
                      SUM(Clicks) AS clk, SUM(Impressions) AS imp FROM m_ad GROUP BY CampaignID) a
      ON a.CampaignID = c.CampaignID
    LEFT JOIN (SELECT CampaignID, {money_sum('TotalAmount')} AS rev, COUNT(*) AS n
               FROM m_orders WHERE CampaignID IS NOT NULL GROUP BY CampaignID) o
      ON o.CampaignID = c.CampaignID""")]

V2_BODY = f"""SELECT CampaignID, Objective, PlatformName, Budget, TotalSpend,
  {ratio('TotalSpend', 'Budget', '100.0')} AS BudgetUtilizationPct, ActualOrderRevenue,
  {ratio('ActualOrderRevenue - TotalSpend', 'TotalSpend', '100.0')} AS ROIPercent, NumAds,
  {ratio('Clicks', 'Impressions', '100.0')} AS CTR FROM m_cfacts"""


def _allocated(key: str, names: str, name_col: str) -> str:
    extra = [
        ("m_og", f"""SELECT o.CampaignID, cu.{key} AS g, COUNT(*) AS n, SUM(o.TotalAmount) AS rev,
                            SUM(SUM(o.TotalAmount)) OVER (PARTITION BY o.CampaignID) AS rev_c
                     FROM m_orders o JOIN m_customer cu ON cu.CustomerID = o.CustomerID
                     GROUP BY o.CampaignID, cu.{key}"""),
        ("m_sc", "SELECT CampaignID, SUM(CAST(CostPerAd * 100 AS BIGINT)) AS spend_cents FROM m_ad GROUP BY CampaignID"),
        ("m_floor", """SELECT g.CampaignID, g.g, g.n, g.rev, CAST(g.rev_c * 100 AS HUGEINT) AS rev_cents,
                        COALESCE(s.spend_cents, 0) AS spend_cents,
                        ROW_NUMBER() OVER (PARTITION BY g.CampaignID ORDER BY g.rev DESC, g.g NULLS FIRST) AS place,
                        CASE WHEN CAST(g.rev_c * 100 AS HUGEINT) > 0
                             THEN CAST(COALESCE(s.spend_cents, 0) AS HUGEINT) * CAST(g.rev * 100 AS HUGEINT)
                                  // CAST(g.rev_c * 100 AS HUGEINT)
                             ELSE 0 END AS share
                       FROM m_og g LEFT JOIN m_sc s ON s.CampaignID = g.CampaignID"""),
        ("m_alloc", """SELECT g, n, rev, share + CASE WHEN place = 1 AND rev_cents > 0
                        THEN spend_cents - SUM(share) OVER (PARTITION BY CampaignID) ELSE 0 END AS alloc FROM m_floor"""),
        ("m_grp", f"""SELECT n.{name_col}, CAST(SUM(a.n) AS BIGINT) AS TotalOrders,
                        {money_sum('a.rev')} AS TotalRevenue, {cents_to('SUM(a.alloc)', 38)} AS TotalSpend
                      FROM m_alloc a JOIN {names} n ON n.{key} = a.g GROUP BY n.{key}, n.{name_col}"""),
    ]
    body = f"""SELECT {name_col}, TotalOrders, TotalRevenue, TotalSpend,
      {ratio('TotalRevenue - TotalSpend', 'TotalSpend', '100.0')} AS ROIPercent FROM m_grp"""
    return _with(body, extra)


V5 = _with(f"""SELECT PlatformName, TotalOrders, TotalRevenue, TotalSpend,
  {ratio('TotalRevenue - TotalSpend', 'TotalSpend', '100.0')} AS ROIPercent FROM (
  SELECT PlatformName, CAST(SUM(TotalOrders) AS BIGINT) AS TotalOrders,
         {money_sum('ActualOrderRevenue')} AS TotalRevenue, {money_sum('TotalSpend')} AS TotalSpend
  FROM m_cfacts WHERE PlatformName IS NOT NULL GROUP BY PlatformName) x""", CFACTS)

V6 = _with("""SELECT l.ProductID, p.ProductName, l.RevenueGenerated FROM (
  SELECT ProductID, CAST(SUM(Price * (1 - Discount)) AS DECIMAL(38,4)) AS RevenueGenerated
  FROM m_order_line GROUP BY ProductID) l JOIN m_product p ON p.ProductID = l.ProductID""")

V7_BODY = f"""SELECT o.CampaignID, s.SegmentName, s.AgeGroup, s.IncomeCategory,
  COUNT(DISTINCT o.OrderID) AS Orders, {money_sum('o.TotalAmount')} AS Revenue
  FROM m_orders o JOIN m_customer cu ON cu.CustomerID = o.CustomerID
  JOIN m_segment s ON s.SegmentID = cu.SegmentID
  WHERE o.CampaignID IS NOT NULL
  GROUP BY o.CampaignID, s.SegmentName, s.AgeGroup, s.IncomeCategory"""

R10_BODY = f"""SELECT cs.SegmentName, pl.PlatformName, COUNT(DISTINCT o.OrderID) AS Orders,
  {money_sum('o.TotalAmount')} AS Revenue
  FROM m_orders o
  JOIN m_campaign c ON c.CampaignID = o.CampaignID
  JOIN m_platform pl ON pl.PlatformID = c.PlatformID
  JOIN m_customer cu ON cu.CustomerID = o.CustomerID
  JOIN m_segment cs ON cs.SegmentID = cu.SegmentID
  GROUP BY cs.SegmentName, pl.PlatformName"""

# The mean of CTR, summed exactly (a double's shortest decimal), compared unrounded.
R9_CTE = [("v", f"SELECT * FROM ({V1}) x WHERE CampaignID IS NOT NULL"),
          ("v_mean", """SELECT CampaignID, CAST(CAST(SUM(CAST(CAST(CTR AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)
                                / COUNT(CTR) AS mean FROM v GROUP BY CampaignID""")]
UNDERPERFORMING = """SELECT v.AdID, v.AdName, v.CampaignID, v.CTR, ROUND(a.mean, 6) AS avg_ctr
  FROM v JOIN v_mean a ON a.CampaignID = v.CampaignID WHERE v.CTR < a.mean * 0.5"""

LIST_CAMPAIGNS = "SELECT CampaignID, PlatformID, StartDate, EndDate, Budget, CurrentBudget, Objective FROM m_campaign"


# --- admission (recursive fold: one step per request of every campaign) -----------

def _fold_ctes() -> list[tuple[str, str]]:
    return [
        ("req", """SELECT AdID AS seq, AdID, CampaignID, CostPerAd, CAST(CostPerAd * 100 AS BIGINT) AS cents,
                          ROW_NUMBER() OVER (PARTITION BY CampaignID ORDER BY AdID) AS rn FROM m_ad"""),
        ("led", "SELECT CampaignID, CAST(Budget * 100 AS BIGINT) - CAST(CurrentBudget * 100 AS BIGINT) AS room FROM m_campaign"),
        ("fold", """
            SELECT r.CampaignID, r.rn, r.seq,
                   CASE WHEN r.cents <= l.room THEN l.room - r.cents ELSE l.room END AS room,
                   r.cents <= l.room AS admitted
            FROM req r JOIN led l ON l.CampaignID = r.CampaignID WHERE r.rn = 1
            UNION ALL
            SELECT r.CampaignID, r.rn, r.seq,
                   CASE WHEN r.cents <= f.room THEN f.room - r.cents ELSE f.room END,
                   r.cents <= f.room
            FROM fold f JOIN req r ON r.CampaignID = f.CampaignID AND r.rn = f.rn + 1"""),
        ("admitted", "SELECT r.seq, r.AdID, r.CampaignID, r.CostPerAd FROM fold f JOIN req r ON r.seq = f.seq WHERE f.admitted"),
    ]


ADMIT = _with("SELECT seq, AdID, CampaignID, CostPerAd FROM admitted", _fold_ctes(), "empty", True)
REJECT = _with("""SELECT r.seq, r.AdID, r.CampaignID, r.CostPerAd, 'Campaign budget exceeded' AS Reason
  FROM fold f JOIN req r ON r.seq = f.seq WHERE NOT f.admitted
  UNION ALL
  SELECT r.seq, r.AdID, r.CampaignID, r.CostPerAd, 'Unknown campaign' AS Reason
  FROM req r WHERE r.CampaignID NOT IN (SELECT CampaignID FROM led) OR r.CampaignID IS NULL""",
               _fold_ctes(), "empty", True)
LEDGER = _with("""SELECT c.CampaignID, c.Budget, CAST(c.CurrentBudget + COALESCE(a.s, 0) AS DECIMAL(14,2)) AS CurrentBudget
  FROM m_campaign c LEFT JOIN (SELECT CampaignID, SUM(CostPerAd) AS s FROM admitted GROUP BY CampaignID) a
  ON a.CampaignID = c.CampaignID""", _fold_ctes(), "empty", True)


CREATE_ADS = _with("""SELECT AdID, CampaignID, AdName, Impressions, Clicks, ConversionRate, CostPerAd, AttributedRevenue
  FROM m_ad
  UNION ALL
  SELECT CAST((SELECT MAX(AdID) FROM m_ad) + ROW_NUMBER() OVER (ORDER BY a.seq) AS BIGINT), m.CampaignID, m.AdName,
         m.Impressions, m.Clicks, CAST(0 AS DOUBLE), m.CostPerAd, CAST(0 AS DECIMAL(18,2))
  FROM admitted a JOIN m_ad m ON m.AdID = a.seq""", _fold_ctes(), "empty", True)

# Two runs: up to the middle of seq budgets are half and campaigns ending in 7 unknown.
STREAM_BUDGETS = _with("""SELECT r.seq, r.AdID, r.CampaignID, r.CostPerAd, COALESCE(f.admitted, FALSE) AS admitted,
    CASE WHEN f.seq IS NULL THEN 'Unknown campaign' WHEN NOT f.admitted THEN 'Campaign budget exceeded' END AS Reason
  FROM bounded r LEFT JOIN bfold f ON f.seq = r.seq""", [
    ("bounded", """SELECT AdID AS seq, AdID, CampaignID, CostPerAd, CAST(CostPerAd * 100 AS BIGINT) AS cents,
                          AdID * 2 <= (SELECT MAX(AdID) FROM m_ad) AS early FROM m_ad"""),
    ("known", """SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.CampaignID ORDER BY b.seq) AS rn,
                        CASE WHEN b.early THEN CAST(c.Budget * 100 AS BIGINT) // 2
                             ELSE CAST(c.Budget * 100 AS BIGINT) END AS budget
                 FROM bounded b JOIN m_campaign c ON c.CampaignID = b.CampaignID
                 WHERE NOT (b.early AND b.CampaignID % 10 = 7)"""),
    ("bfold", """
        SELECT CampaignID, rn, seq, CASE WHEN cents <= budget THEN cents ELSE 0 END AS spent, cents <= budget AS admitted
        FROM known WHERE rn = 1
        UNION ALL
        SELECT k.CampaignID, k.rn, k.seq, CASE WHEN f.spent + k.cents <= k.budget THEN f.spent + k.cents ELSE f.spent END,
               f.spent + k.cents <= k.budget
        FROM bfold f JOIN known k ON k.CampaignID = f.CampaignID AND k.rn = f.rn + 1""")], "empty", True)


# --- writes ------------------------------------------------------------------------

NEW_CAMPAIGNS = [("newc", """SELECT CampaignID AS seq,
    (SELECT MAX(CampaignID) FROM m_campaign) + ROW_NUMBER() OVER (ORDER BY CampaignID) AS NewID,
    PlatformID, StartDate, EndDate, Budget, Objective FROM m_campaign""")]

CREATE = _with("""SELECT CampaignID, PlatformID, StartDate, EndDate, Budget, CurrentBudget, Objective FROM m_campaign
  UNION ALL
  SELECT NewID, PlatformID, StartDate, EndDate, Budget, CAST(0 AS DECIMAL(14,2)), Objective FROM newc""", NEW_CAMPAIGNS)

ASSIGN = _with("SELECT seq, CAST(NewID AS BIGINT) AS CampaignID FROM newc", NEW_CAMPAIGNS)

UPDATE_BUDGETS = _with("""SELECT c.CampaignID, c.PlatformID, c.StartDate, c.EndDate,
    CASE WHEN l.CampaignID IS NOT NULL THEN l.Budget ELSE c.Budget END AS Budget, c.CurrentBudget, c.Objective
  FROM m_campaign c LEFT JOIN (SELECT CampaignID, arg_max(Budget, seq) AS Budget FROM breq GROUP BY CampaignID) l
  ON l.CampaignID = c.CampaignID""", [("breq", """
    SELECT CampaignID, CampaignID * 2 AS seq, CAST(CurrentBudget AS DECIMAL(14,2)) AS Budget
    FROM m_campaign WHERE CurrentBudget > Budget
    UNION ALL SELECT CampaignID, CampaignID * 2 + 1, CAST(ROUND(CurrentBudget * 1.1, 2) AS DECIMAL(14,2))
    FROM m_campaign WHERE CurrentBudget > Budget
    UNION ALL SELECT CampaignID + 1000000000000, 0, Budget FROM m_campaign WHERE CurrentBudget > Budget""")])

AD_UPD = [("m_ad_upd", """SELECT a.AdID, a.CampaignID, a.AdName,
    CASE WHEN a.Clicks > 0 THEN a.Impressions * 2 ELSE a.Impressions END AS Impressions,
    CASE WHEN a.Clicks > 0 THEN a.Clicks * 2 ELSE a.Clicks END AS Clicks,
    a.ConversionRate, a.CostPerAd, a.AttributedRevenue, a.Clicks > 0 AS touched FROM m_ad a""")]

UPDATE_AD_METRICS = _with(_recalc("m_ad_upd", "a.touched"), AD_UPD)
RECALC_AD_METRICS = _with(_recalc("m_ad_upd"), AD_UPD)

PRICE = _with("SELECT CampaignID, ProductID, Discount, SellingPrice FROM m_cp")

PRICE_REJECTS = _with("""SELECT seq, CampaignID, ProductID, Discount, Reason FROM (
    SELECT *, CASE WHEN seq IS NULL THEN 'missing seq' WHEN place > 1 THEN 'duplicate request in batch'
                   WHEN (CampaignID, ProductID) IN (SELECT (CampaignID, ProductID) FROM m_cp WHERE ProductID % 2 = 0)
                   THEN 'pair already exists'
                   WHEN ProductID NOT IN (SELECT ProductID FROM m_product) THEN 'unknown product' END AS Reason
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY CampaignID, ProductID ORDER BY seq NULLS LAST, Discount) AS place
          FROM preq) p) q WHERE Reason IS NOT NULL""", [
    ("preq0", """SELECT CASE WHEN ProductID % 11 = 0 THEN NULL ELSE ProductID END AS seq, CampaignID,
                        CASE WHEN ProductID % 7 = 0 THEN ProductID + 1000000000000 ELSE ProductID END AS ProductID,
                        Discount FROM m_cp"""),
    ("preq", """SELECT * FROM preq0
                UNION ALL SELECT seq + 1, CampaignID, ProductID, Discount FROM preq0 WHERE ProductID % 2 = 1""")])

REQUEST_TEXT = [("rt", """SELECT CAST(CampaignID AS VARCHAR) AS seq, '  ' || CAST(PlatformID AS VARCHAR) AS PlatformID,
    CASE WHEN CampaignID % 13 = 5 THEN 'soon' ELSE CAST(StartDate AS VARCHAR) END AS StartDate,
    CASE WHEN CampaignID % 7 = 3 THEN ' ' ELSE CAST(EndDate AS VARCHAR) END AS EndDate,
    CASE WHEN CampaignID % 17 = 4 THEN '12,50' WHEN CampaignID % 19 = 6 THEN ''
         ELSE CAST(Budget AS VARCHAR) || ' ' END AS Budget, Objective FROM m_campaign""")]
TYPED = _with("""SELECT CAST(seq AS BIGINT) AS seq, CAST(trim(PlatformID) AS BIGINT) AS PlatformID,
    CAST(StartDate AS DATE) AS StartDate, CAST(NULLIF(trim(EndDate), '') AS DATE) AS EndDate,
    CAST(trim(Budget) AS DECIMAL(14,2)) AS Budget, Objective
  FROM rt WHERE StartDate <> 'soon' AND Budget NOT IN ('12,50', '')""", REQUEST_TEXT)
UNTYPED = _with("""SELECT *, CASE WHEN StartDate = 'soon' THEN 'StartDate does not parse'
    WHEN Budget = '12,50' THEN 'Budget does not parse' ELSE 'Budget is missing' END AS Reason
  FROM rt WHERE StartDate = 'soon' OR Budget IN ('12,50', '')""", REQUEST_TEXT)

CP_UPD = [("m_cp_upd", """SELECT CampaignID, ProductID,
    CASE WHEN Discount = 0 THEN CAST(5 AS DECIMAL(5,2)) ELSE Discount END AS Discount,
    SellingPrice FROM m_cp""")]

UPDATE_DISCOUNTS = _with("SELECT CampaignID, ProductID, Discount, SellingPrice FROM m_cp_upd", CP_UPD)
STALE = _with(f"""SELECT CampaignID, ProductID, Discount, SellingPrice, ExpectedPrice FROM (
  SELECT cp.CampaignID, cp.ProductID, cp.Discount, cp.SellingPrice, {price_sql('p.MRP', 'cp.Discount')} AS ExpectedPrice
  FROM m_cp_upd cp JOIN m_product p ON p.ProductID = cp.ProductID) x
  WHERE SellingPrice IS DISTINCT FROM ExpectedPrice""", CP_UPD)


# --- text ------------------------------------------------------------------------------

def _txt(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), 'null')"


R10_CTE = [("r10", R10_BODY)]
LINES = _with(f"""SELECT 'SegmentName=' || {_txt('SegmentName')} || ' | PlatformName=' || {_txt('PlatformName')}
  || ' | Orders=' || {_txt('Orders')} || ' | Revenue=' || {_txt('Revenue')} AS line FROM r10""", R10_CTE)
LINES_FMT = _with(f"""SELECT 'Segment=' || {_txt('SegmentName')} || ' | Platform=' || {_txt('PlatformName')}
  || ' | Orders=' || {_txt('Orders')} || ' | Revenue=' || {_txt('CAST(Revenue AS DECIMAL(38,2))')} AS line
  FROM r10""", R10_CTE)
LINES_PARSE = _with(f"""SELECT {_txt('SegmentName')} AS SegmentName, {_txt('PlatformName')} AS PlatformName,
  {_txt('Orders')} AS Orders, {_txt('Revenue')} AS Revenue FROM r10""", R10_CTE)


# --- digest --------------------------------------------------------------------------

DIGEST = """WITH u AS (
  SELECT c_name AS Username,
         sha256(CASE WHEN c_acctbal < 0 THEN c_name || '!' ELSE c_name END) AS PasswordHash,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'OTHER' ELSE 'MARKETING' END AS Role
  FROM customer)
SELECT c.c_custkey AS CustomerID, COALESCE(u.PasswordHash = sha256(c.c_name), FALSE) AS matched
FROM customer c LEFT JOIN (SELECT * FROM u WHERE Role = 'MARKETING') u ON u.Username = c.c_name"""


# --- streams -----------------------------------------------------------------------

FEED = [("feed", """SELECT user_id AS AdID,
    CAST(COUNT(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS Impressions,
    CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS Clicks
  FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id"""),
        ("m_ad_feed", """SELECT a.AdID, a.CampaignID, a.AdName,
    CASE WHEN f.AdID IS NOT NULL THEN f.Impressions ELSE a.Impressions END AS Impressions,
    CASE WHEN f.AdID IS NOT NULL THEN f.Clicks ELSE a.Clicks END AS Clicks,
    a.ConversionRate, a.CostPerAd, a.AttributedRevenue, f.AdID IS NOT NULL AS touched
  FROM m_ad a LEFT JOIN feed f ON f.AdID = a.AdID""")]

STREAM_METRICS = _with(_recalc("m_ad_feed", "a.touched"), FEED)


# Output columns each registered query presents as DOUBLE (money, computed
# exactly in decimal and converted last) and as ISO text (dates): the
# representations both engines hand to pandas, Arrow and Python alike.
PRESENTED: dict[str, tuple[list[str], list[str]]] = {
    'load_campaigns': (['Budget', 'CurrentBudget'], ['StartDate', 'EndDate']),
    'view_catalog': (['Budget', 'TotalSpend', 'ActualOrderRevenue'], []),
    'ad_performance_bound': (['AttributedRevenue', 'CostPerAd'], []),
    'vw_ad_performance': (['AttributedRevenue', 'CostPerAd'], []),
    'vw_campaign_performance': (['Budget', 'TotalSpend', 'ActualOrderRevenue'], []),
    'vw_region_performance': (['TotalRevenue', 'TotalSpend'], []),
    'vw_segment_performance': (['TotalRevenue', 'TotalSpend'], []),
    'vw_platform_performance': (['TotalRevenue', 'TotalSpend'], []),
    'vw_product_performance': (['RevenueGenerated'], []),
    'vw_campaign_by_segment': (['Revenue'], []),
    'list_campaigns': (['Budget', 'CurrentBudget'], ['StartDate', 'EndDate']),
    'campaign_performance': (['Budget', 'TotalSpend', 'ActualOrderRevenue'], []),
    'ad_performance': (['AttributedRevenue', 'CostPerAd'], []),
    'campaign_products': (['MRP', 'Discount', 'SellingPrice'], []),
    'region_performance': (['TotalRevenue', 'TotalSpend'], []),
    'segment_performance': (['TotalRevenue', 'TotalSpend'], []),
    'platform_performance': (['TotalRevenue', 'TotalSpend'], []),
    'product_performance': (['RevenueGenerated'], []),
    'campaign_by_segment': (['Revenue'], []),
    'budget_alerts': (['Budget', 'TotalSpend'], []),
    'campaigns_ending_soon': ([], ['EndDate']),
    'top_ads_by_roas': (['CostPerAd', 'AttributedRevenue'], []),
    'segment_platform_affinity': (['Revenue'], []),
    'create_campaigns': (['Budget', 'CurrentBudget'], ['StartDate', 'EndDate']),
    'update_budgets': (['Budget', 'CurrentBudget'], ['StartDate', 'EndDate']),
    'admit_ads': (['CostPerAd'], []),
    'rejected_ads': (['CostPerAd'], []),
    'update_ad_metrics': (['CostPerAd', 'AttributedRevenue'], []),
    'recalc_ad_metrics': (['CostPerAd', 'AttributedRevenue'], []),
    'price_campaign_products': (['Discount', 'SellingPrice'], []),
    'update_discounts': (['Discount', 'SellingPrice'], []),
    'typed_requests': (['Budget'], ['StartDate', 'EndDate']),
    'create_ads': (['CostPerAd', 'AttributedRevenue'], []),
    'price_rejects': (['Discount'], []),
    'stream_budget_changes': (['CostPerAd'], []),
    'stale_prices': (['Discount', 'SellingPrice', 'ExpectedPrice'], []),
    'campaign_spend_ledger': (['Budget', 'CurrentBudget'], []),
    'stream_admit_ads': (['CostPerAd'], []),
    'stream_ad_metrics': (['CostPerAd', 'AttributedRevenue'], []),
}


def _present(key: str, sql: str) -> str:
    dec, dat = PRESENTED.get(key, ([], []))
    if not dec and not dat:
        return sql
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in dec] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dat]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n) presented"


_ORACLE: dict[str, str] = {
    "load_campaigns": _with(LIST_CAMPAIGNS),
    "view_catalog": _with(V2_BODY, CFACTS),
    "ad_performance_bound": _with(f"SELECT * FROM ({V1}) v WHERE CampaignID = 4"),
    "report_lines": LINES,
    "report_lines_parse": LINES_PARSE,
    "report_lines_reread": LINES_PARSE,
    "report_lines_fmt": LINES_FMT,
    "vw_ad_performance": _with(V1),
    "vw_campaign_performance": _with(V2_BODY, CFACTS),
    "vw_region_performance": _allocated("RegionID", "m_region", "RegionName"),
    "vw_segment_performance": _allocated("SegmentID", "m_segment", "SegmentName"),
    "vw_platform_performance": V5,
    "vw_product_performance": V6,
    "vw_campaign_by_segment": _with(V7_BODY),
    "list_campaigns": _with(LIST_CAMPAIGNS),
    "campaign_performance": _with(V2_BODY, CFACTS),
    "ad_performance": _with(V1),
    "campaign_products": _with("""SELECT cp.ProductID, p.ProductName, p.MRP, cp.Discount, cp.SellingPrice
      FROM m_cp cp JOIN m_product p ON p.ProductID = cp.ProductID WHERE cp.CampaignID = 4"""),
    "region_performance": _allocated("RegionID", "m_region", "RegionName"),
    "segment_performance": _allocated("SegmentID", "m_segment", "SegmentName"),
    "platform_performance": V5,
    "product_performance": V6,
    "campaign_by_segment": _with(f"SELECT * FROM ({V7_BODY}) v WHERE CampaignID = 4"),
    "budget_alerts": _with(f"""SELECT CampaignID, Objective, Budget, TotalSpend, BudgetUtilizationPct
      FROM ({V2_BODY}) v WHERE BudgetUtilizationPct >= 85.0""", CFACTS),
    "campaigns_ending_soon": _with("""SELECT CampaignID, Objective, EndDate,
      CAST(date_diff('day', DATE '2001-07-20', EndDate) AS INTEGER) AS DaysLeft FROM m_campaign
      WHERE EndDate >= DATE '2001-07-20' AND date_diff('day', DATE '2001-07-20', EndDate) <= 14"""),
    "top_ads_by_roas": _with(f"""SELECT AdID, AdName, CampaignID, ROAS, CostPerAd, AttributedRevenue
      FROM ({V1}) v WHERE ROAS IS NOT NULL ORDER BY ROAS DESC, AdID LIMIT 10"""),
    "underperforming_ads": _with(UNDERPERFORMING, R9_CTE),
    "segment_platform_affinity": _with(R10_BODY),
    "create_campaigns": CREATE,
    "assign_ids": ASSIGN,
    "assign_stored_ids": ASSIGN,
    "update_budgets": UPDATE_BUDGETS,
    "admit_ads": ADMIT,
    "rejected_ads": REJECT,
    "update_ad_metrics": UPDATE_AD_METRICS,
    "recalc_ad_metrics": RECALC_AD_METRICS,
    "price_campaign_products": PRICE,
    "update_discounts": UPDATE_DISCOUNTS,
    "stale_prices": STALE,
    "campaign_spend_ledger": LEDGER,
    "digest_match": DIGEST,
    "create_ads": CREATE_ADS,
    "typed_requests": TYPED,
    "rejected_requests": UNTYPED,
    "price_rejects": PRICE_REJECTS,
    "stream_budget_changes": STREAM_BUDGETS,
    "stream_admit_ads": ADMIT,
    "stream_ad_metrics": STREAM_METRICS,
    "stream_daily_counters": """
WITH d AS (SELECT user_id AS AdID, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS seq,
       count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c
  FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL GROUP BY ALL)
SELECT seq, AdID, (sum(v) OVER w)::BIGINT AS Impressions, (sum(c) OVER w)::BIGINT AS Clicks
FROM d WINDOW w AS (PARTITION BY AdID ORDER BY seq)""",
}


def _line(fmt: str, columns: list[str], ratios: tuple[str, ...]) -> str:
    """A report's format as a SQL expression (written apart from the Spark side's)."""
    out, rest, names = [], fmt, iter(columns)
    while "%" in rest:
        text, _, rest = rest.partition("%")
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        if rest.startswith("%"):
            out.append("'%'")
            rest = rest[1:]
        elif rest.startswith("s"):
            c = next(names)
            out.append(_txt(f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,4))" if c in ratios else c))
            rest = rest[1:]
        elif rest.startswith("d"):
            out.append(f"COALESCE(CAST({next(names)} AS VARCHAR), '0')")
            rest = rest[1:]
        else:
            digits = rest[1:rest.index("f")]
            out.append(_txt(f"CAST(CAST({next(names)} AS VARCHAR) AS DECIMAL(38,{digits}))"))
            rest = rest[rest.index("f") + 1:]
    if rest:
        out.append("'" + rest + "'")
    return " || ".join(out)


def _all_lines() -> str:
    from ..operators.text import REPORT_FORMATS
    ratios = ("CTR", "ConversionRate", "CostPerClick", "ROAS", "ROIPercent", "BudgetUtilizationPct", "avg_ctr")
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, {_line(fmt, cols, ratios)} AS line FROM (\n{_ORACLE[name]}\n) r"
        for name, (fmt, cols) in REPORT_FORMATS.items())


_ORACLE["report_lines_all"] = _all_lines()

# Views from stored rollups equal the views over the facts.
for _rollup, _view in {
        "rollup_campaign_performance": "vw_campaign_performance", "rollup_region_performance": "vw_region_performance",
        "rollup_segment_performance": "vw_segment_performance", "rollup_platform_performance": "vw_platform_performance",
        "rollup_product_performance": "vw_product_performance", "rollup_campaign_by_segment": "vw_campaign_by_segment",
        "rollup_segment_platform_affinity": "segment_platform_affinity"}.items():
    _ORACLE[_rollup] = _ORACLE[_view]
    PRESENTED[_rollup] = PRESENTED[_view]

#: The order of rows each listing and report has, beside its values.
REPORT_ORDER = {
    "list_campaigns": "CampaignID",
    "campaign_performance": "ROIPercent DESC NULLS LAST, CampaignID",
    "ad_performance": "ROAS DESC NULLS LAST, AdID",
    "ad_performance_bound": "ROAS DESC NULLS LAST, AdID",
    "campaign_products": "ProductName, ProductID",
    "region_performance": "TotalRevenue DESC NULLS LAST, RegionName",
    "segment_performance": "TotalRevenue DESC NULLS LAST, SegmentName",
    "platform_performance": "TotalRevenue DESC NULLS LAST, PlatformName",
    "product_performance": "RevenueGenerated DESC NULLS LAST, ProductID",
    "campaign_by_segment": "Revenue DESC NULLS LAST, SegmentName",
    "budget_alerts": "BudgetUtilizationPct DESC NULLS LAST, CampaignID",
    "campaigns_ending_soon": "DaysLeft, CampaignID",
    "top_ads_by_roas": "ROAS DESC NULLS LAST, AdID",
    "underperforming_ads": "CTR, AdID",
    "segment_platform_affinity": "Revenue DESC NULLS LAST, SegmentName, PlatformName",
    "report_lines_reread": "CAST(Revenue AS DECIMAL(38,2)) DESC NULLS LAST, SegmentName, PlatformName",
}


def _ordered(key: str, sql: str) -> str:
    return f"SELECT * FROM (\n{sql}\n) report ORDER BY {REPORT_ORDER[key]}" if key in REPORT_ORDER else sql


ORACLE: dict[str, str] = {key: _ordered(key, _present(key, sql)) for key, sql in _ORACLE.items()}
