"""DataFrame to DataFrame operators.

Between modules the column names are series, ts, date, mtu, value, model, tau, q,
y_true and y_pred.
"""
