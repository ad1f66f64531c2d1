"""kpiloom: order and customer KPIs as Spark DataFrame transformations.

Every operator is a function from DataFrames to a DataFrame (or from columns to
a column).  The session and the as-of time always come from the caller, and no
operator runs an action unless its name says that it writes or materialises.
"""
