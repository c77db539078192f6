"""Fetchers that write down what they are asked for."""

import datetime as dt

FIRST = dt.date(2020, 1, 1)


def logged(ticker, start, end, log):
    with open(f"{log}/{ticker}-{start}-{end}", "w"):
        pass
    for k in range(30):
        d = FIRST + dt.timedelta(k)
        if start <= d <= end:
            yield d, float(ord(ticker[0]) + k)
