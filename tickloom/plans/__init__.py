"""Plan shapes shared by the operators: slicing, scans, quantiles, small joins."""
