"""Schemas and the fixed values that define results.

The values below are part of the results (feature order, weights, thresholds), so they
are stated once, here, and every operator reads them from this module.
"""

from __future__ import annotations

from pyspark.sql import types as T

BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("adjusted_close", T.DoubleType()),
        T.StructField("currency", T.StringType()),
    ]
)

# Index (dimension) columns, in file order.
DIM_COLUMNS = [
    "symbol",
    "company_name",
    "sector",
    "market_cap",
    "headquarters",
    "exchange",
    "currency",
    "isin",
]
MASTER_COLUMNS = DIM_COLUMNS[:6]

# Header variants accepted by the bar and index readers.
COLUMN_VARIANTS = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
    "Adj Close": "adjusted_close",
    "Adjusted Close": "adjusted_close",
    "Symbol": "symbol",
    "Company Name": "company_name",
    "Sector": "sector",
    "Market Cap": "market_cap",
    "Headquarters": "headquarters",
    "Exchange": "exchange",
    "Currency": "currency",
}

# Prediction table columns, in order, with the default for a missing one.
PREDICTION_COLUMNS = [
    ("date", "date", None),
    ("horizon", "string", ""),
    ("predicted_price", "double", 0.0),
    ("current_price", "double", 0.0),
    ("confidence", "double", 0.0),
    ("confidence_low", "double", 0.0),
    ("confidence_high", "double", 0.0),
    ("algorithm_used", "string", ""),
    ("currency", "string", "USD"),
    ("last_updated", "timestamp", None),
    ("model_accuracy", "double", 0.0),
    ("data_points_used", "bigint", 0),
]

# Forecast horizons in calendar days.
HORIZON_DAYS = {"1D": 1, "1W": 7, "1M": 30, "1Y": 365, "5Y": 1825}

# Ensemble weight and accuracy multiplier per model.
MODEL_WEIGHTS = {
    "random_forest": 0.4,
    "decision_tree": 0.3,
    "linear_regression": 0.3,
    "svm": 0.0,
    "knn": 0.0,
    "ann": 0.0,
    "cnn": 0.0,
    "arima": 0.0,
    "autoencoder": 0.0,
}
ACCURACY_MULTIPLIERS = {
    "ann": 1.05,
    "cnn": 1.05,
    "autoencoder": 1.05,
    "arima": 1.05,
    "random_forest": 1.03,
}
UNKNOWN_MODEL_WEIGHT = 0.1

# Confidence component weights.
SINGLE_WEIGHTS = {"accuracy": 0.50, "volatility": 0.25, "decay": 0.25}
ENSEMBLE_WEIGHTS = {"accuracy": 0.30, "agreement": 0.25, "volatility": 0.20, "decay": 0.25}

# Thresholds.
FALLBACK_USD_INR = 83.5
MIN_TRAINING_ROWS = 252
MIN_SERVING_ROWS = 90
LOOKBACK = 60
RSI_PERIOD = 14
INTERVAL_Z = 1.96
PRICE_MIN, PRICE_MAX = 0.01, 100000.0
MAX_MOVE = 5.0
MAX_GAP_DAYS = 7
SEARCH_PER_CATEGORY, SEARCH_CAP = 10, 20
MOVING_AVERAGES = [5, 10, 20, 50, 200]
LAGS = [1, 2, 3, 5, 10]
ROLLING = [5, 10, 20]

# The model feature contract, in order.
FEATURES_38 = [
    "open", "high", "low", "price_change", "price_change_abs", "volatility", "rsi",
    "hl_ratio", "oc_ratio", "price_position", "day_of_week", "month", "quarter", "market_type",
    "ma_5", "ma_5_ratio", "ma_10", "ma_10_ratio", "ma_20", "ma_20_ratio", "ma_50", "ma_50_ratio", "ma_200", "ma_200_ratio",
    "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5", "close_lag_10",
    "close_std_5", "close_min_5", "close_max_5", "close_std_10", "close_min_10", "close_max_10", "close_std_20", "close_min_20", "close_max_20",
]

# Name parts that mark an Indian listing when the dimension knows no better.
IND_NAME_PARTS = [
    "RELIANCE", "TCS", "INFY", "HDFC", "ICICI", "WIPRO", "MARUTI", "BAJAJ",
    "TATA", "ADANI", "LT", "ITC", "BHARTI", "ONGC", "SBI", "NTPC", "POWER",
    "COAL", "GAIL", "BPCL", "HPCL", "IOC", "BANK",
]
