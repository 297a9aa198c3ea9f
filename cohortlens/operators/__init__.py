"""DataFrame -> DataFrame operators. No operator collects to the driver."""
