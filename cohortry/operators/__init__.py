"""DataFrame -> DataFrame operators; all lazy, none collects table rows to the driver."""
