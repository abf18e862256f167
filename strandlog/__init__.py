"""Analytics over versioned, linked data: one revision log, answered by DataFrame programs."""
