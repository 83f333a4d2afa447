"""Plans that run in rounds over DataFrames."""
