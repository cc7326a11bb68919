"""Analytics over index membership and free float, written as DataFrame plans."""
