"""Order histories as episodes: the library applied to the tables orders, lineitem and customer."""
